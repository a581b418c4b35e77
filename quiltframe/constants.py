"""Word lists, patterns and limits that define results."""

# --- Patterns -------------------------------------------------------------
PII_PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}
EMAIL_CELL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
ID_CELL = r"^[A-Za-z]+[-_]?\d+$"
ID_COLUMN_FIT = (
    r"(?i)(^id$|_id$|_id_|order_id|orderid|transaction_id|employee_id|account_id|"
    r"patient_id|claim_id|policy_id|kyc_id|ref_id|uuid|sku|imei|msisdn|"
    r"upi_ref|rrn|loan_id|booking_id)"
)
ID_COLUMN_REPORT = (
    r"(?i)(^id$|_id$|order_id|transaction_id|employee_id|account_id|patient_id|claim_id|"
    r"policy_id|kyc_id|ref_id|uuid|sku|imei|msisdn|loan_id|booking_id)"
)
DECIMAL_COLUMN = (
    r"(?i)price|amount|cost|fee|rating|percent|pct|discount|tax|subtotal|"
    r"balance|salary|wage|usd|inr|eur"
)

# --- Boolean labels -------------------------------------------------------
TRUE_WORDS = ["true", "yes", "y", "t"]
FALSE_WORDS = ["false", "no", "n", "f"]
BOOLEAN_WORDS = ["1", "0", "yes", "no", "y", "n", "t", "f", "true", "false"]
# Labels the categorical model unifies (compared case-sensitively).
MODEL_TRUE = ["True", "true", "1", "yes"]
MODEL_FALSE = ["False", "false", "0", "no"]

# --- Role vocabulary ------------------------------------------------------
OPEN_ROLES = [
    "person_name", "first_name", "last_name", "email", "city", "address",
    "phone", "company", "job", "state", "country", "text_open",
    "aadhaar", "pan", "ifsc", "upi", "pincode", "gstin",
]
CLOSED_ROLES = ["closed_categorical", "product"]

TEXT_BY_NAME = [
    "aadhaar", "aadhar", "ifsc", "gstin", "upi", "phone", "mobile",
    "contact_no", "tel", "msisdn",
]
TEXT_BY_EXACT_NAME = [
    "pan", "pan_number", "pan_card", "vpa", "upi_id", "gst", "gst_number",
    "pincode", "pin_code", "zip", "zipcode", "postal_code",
]
PERSON_ROLE_KEYS = [
    "doctor", "physician", "surgeon", "nurse", "specialist", "consultant",
    "practitioner", "agent_name", "driver", "doctor_name", "physician_name",
    "attending", "caregiver",
]
PERSON_NAME_PARTS = [
    "full_name", "customer_name", "account_holder", "employee_name",
    "patient_name", "holder_name", "beneficiary", "insured_name",
    "farmer_name", "subscriber_name", "user_name",
]
PERSON_FALLBACK_NAMES = [
    "customer_name", "account_holder", "full_name", "employee_name", "name",
    "patient_name", "holder_name", "beneficiary_name", "insured_name",
    "farmer_name", "subscriber_name", "user_name", "username",
    "doctor", "physician", "surgeon", "nurse", "specialist", "consultant",
    "practitioner", "agent_name", "driver", "doctor_name", "physician_name",
]
VENDOR_PARTS = [
    "courier", "carrier", "logistics", "vendor", "provider", "bank_name",
    "insurer", "shipping_partner", "delivery_partner", "fleet",
]
CITY_PARTS = ["city", "shipping_city", "billing_city", "town", "village", "district"]
ADDRESS_PARTS = ["address", "street", "location", "geo"]
PHONE_PARTS = ["phone", "mobile", "contact_no", "tel", "msisdn"]
COMPANY_PARTS = ["company", "employer", "organization", "org_name", "hospital"]
ENUM_NAME_PARTS = [
    "status", "method", "department", "designation", "position",
    "type", "mode", "channel", "gender", "education", "priority",
    "stage", "plan", "tier", "band", "crop_type", "claim_status",
    "payment", "order_status", "txn_type", "kyc_status", "churn",
    "risk", "coverage", "diagnosis", "blood_group", "network",
]
JOB_PARTS = ["job", "job_title", "occupation"]
PRODUCT_PARTS = [
    "product_name", "product", "medicine", "drug", "sku_name", "item_name", "crop_name",
]
REPORT_PERSON_PARTS = ["full_name", "customer_name", "employee_name", "patient_name", "doctor"]
NOTE_PARTS = ["note", "comment", "description", "remark", "summary"]

LINKED_COLUMNS = [
    ["product_name", "category", "unit_price"],
    ["product", "category", "unit_price"],
    ["medicine_name", "category", "unit_price"],
    ["crop_name", "crop_type", "yield_kg"],
]

# --- Domain labels, first hit wins ---------------------------------------
DOMAIN_KEYWORDS = [
    ("healthcare", ["patient", "diagnosis", "doctor", "admission"]),
    ("ecommerce", ["order_id", "product", "courier", "shipping"]),
    ("hr", ["employee", "salary", "department", "designation"]),
    ("banking", ["upi", "aadhaar", "ifsc", "kyc", "account"]),
    ("insurance", ["claim", "policy", "premium", "insured"]),
    ("telecom", ["msisdn", "churn", "telecom", "subscriber"]),
    ("agriculture", ["crop", "yield", "farmer", "acre"]),
]

# --- Deduplication keys ---------------------------------------------------
KEY_ID_WORDS = ["id", "uuid", "key", "number", "code", "reference"]
KEY_TIME_WORDS = ["date", "time", "timestamp", "created", "updated", "datetime"]
KEY_PRESETS = {
    "toll": {
        "unique": ["vehicle_number", "transaction_id", "fastag_id"],
        "conflict": ["vehicle_type", "vehicle_class"],
        "strict": ["vehicle_number"],
    },
    "personal": {
        "unique": ["email", "phone", "id"],
        "conflict": ["first_name", "last_name", "address"],
        "strict": ["email"],
    },
    "sales": {
        "unique": ["transaction_id", "customer_id"],
        "conflict": ["product", "category", "quantity"],
        "strict": ["transaction_id"],
    },
    "employee": {
        "unique": ["employee_id", "email"],
        "conflict": ["department", "position", "salary"],
        "strict": ["employee_id"],
    },
    "healthcare": {
        "unique": ["patient_id", "email"],
        "conflict": ["condition", "medication"],
        "strict": ["patient_id"],
    },
}
SIMILARITY_THRESHOLD = 0.85

# --- India context --------------------------------------------------------
INDIA_COLUMN_WORDS = [
    "aadhaar", "aadhar", "ifsc", "upi", "gstin", "pincode", "kyc", "fastag", "toll",
]
INDIA_CITY_HINTS = [
    "delhi", "mumbai", "kolkata", "chennai", "bangalore", "bengaluru", "hyderabad",
    "pune", "ahmedabad", "jaipur", "lucknow", "kanpur", "nagpur", "indore",
    "bhopal", "patna", "chandigarh", "surat", "kochi", "gurgaon", "gurugram",
    "noida", "ghaziabad", "faridabad", "varanasi", "agra", "mysuru", "vadodara",
]
INDIA_CITIES = [
    "Mumbai", "Delhi", "Bengaluru", "Hyderabad", "Ahmedabad", "Chennai", "Kolkata",
    "Pune", "Jaipur", "Lucknow", "Kanpur", "Nagpur", "Indore", "Thane", "Bhopal",
    "Visakhapatnam", "Patna", "Vadodara", "Ghaziabad", "Ludhiana", "Agra", "Nashik",
    "Faridabad", "Meerut", "Rajkot", "Varanasi", "Srinagar", "Amritsar", "Gurugram",
    "Noida", "Coimbatore", "Chandigarh", "Guwahati", "Mysuru", "Raipur", "Kota",
]
UPI_HANDLES = ["oksbi", "okhdfcbank", "okicici", "paytm", "ybl", "apl", "axl"]
IFSC_BANKS = ["SBIN", "HDFC", "ICIC", "AXIS", "PUNB", "UBIN", "CNRB", "KKBK"]
DEFAULT_EMAIL_DOMAINS = ["gmail.com", "yahoo.com", "outlook.com"]

# --- Vocabularies of our own for dictionary columns -----------------------
FIRST_NAMES = [
    "Aarav", "Ada", "Amara", "Anil", "Anna", "Bela", "Carlos", "Chen", "Clara", "Dana",
    "Deepa", "Elena", "Emil", "Farah", "Felix", "Grace", "Hana", "Hugo", "Ines", "Ivan",
    "Jonas", "Kavya", "Kofi", "Lena", "Liam", "Maya", "Meera", "Nadia", "Noah", "Olga",
    "Omar", "Priya", "Rahul", "Rosa", "Sam", "Sofia", "Tara", "Tomas", "Yara", "Zoe",
]
LAST_NAMES = [
    "Adler", "Bakshi", "Berg", "Castro", "Chandra", "Cole", "Diaz", "Dutta", "Eriksen", "Falk",
    "Fischer", "Garcia", "Ghosh", "Hansen", "Iyer", "Jansen", "Joshi", "Kaya", "Khan", "Klein",
    "Kumar", "Larsen", "Lopez", "Mehta", "Moreau", "Nair", "Novak", "Okoro", "Patel", "Quinn",
    "Rao", "Reddy", "Rossi", "Sato", "Sharma", "Silva", "Singh", "Tanaka", "Weber", "Young",
]
CITIES = [
    "Ashford", "Brookfield", "Clearwater", "Dunmore", "Eastport", "Fairview", "Glenwood",
    "Harborview", "Kingsley", "Lakeside", "Milton", "Northgate", "Oakdale", "Pinehurst",
    "Riverton", "Springdale", "Stonebridge", "Westbrook", "Whitfield", "Woodhaven",
]
STATES = [
    "Alabama", "Arizona", "California", "Colorado", "Florida", "Georgia", "Illinois",
    "Michigan", "Nevada", "New York", "Ohio", "Oregon", "Texas", "Utah", "Washington",
]
INDIA_STATES = [
    "Andhra Pradesh", "Assam", "Bihar", "Gujarat", "Haryana", "Karnataka", "Kerala",
    "Maharashtra", "Odisha", "Punjab", "Rajasthan", "Tamil Nadu", "Telangana",
    "Uttar Pradesh", "West Bengal",
]
COUNTRIES = [
    "Argentina", "Australia", "Brazil", "Canada", "Denmark", "Egypt", "France", "Germany",
    "India", "Italy", "Japan", "Kenya", "Mexico", "Norway", "Spain", "Thailand",
]
STREETS = [
    "Cedar Street", "Elm Avenue", "Hill Road", "Lake Drive", "Maple Lane", "Market Street",
    "Mill Road", "Park Avenue", "River Walk", "Station Road", "Sunset Boulevard", "Temple Street",
]
COMPANIES = [
    "Bluepeak Ltd", "Cobalt Works", "Delta Trade", "Evergreen Group", "Fernhill Foods",
    "Granite Systems", "Harvest Partners", "Ironwood Labs", "Juniper Textiles", "Keystone Freight",
    "Lumen Energy", "Monsoon Media",
]
JOBS = [
    "Accountant", "Architect", "Chef", "Data Analyst", "Electrician", "Engineer", "Farmer",
    "Journalist", "Lawyer", "Librarian", "Mechanic", "Nurse", "Pharmacist", "Pilot", "Plumber",
    "Sales Manager", "Scientist", "Teacher", "Translator", "Writer",
]
WORDS = [
    "account", "after", "begin", "candle", "detail", "early", "factor", "garden", "harbor",
    "issue", "journey", "kitchen", "letter", "market", "network", "office", "paper", "quiet",
    "river", "season", "table", "under", "value", "window", "yellow", "zone",
]
FREE_EMAIL_DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com"]
