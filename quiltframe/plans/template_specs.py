"""The eleven table templates as column specs.

Names starting with an underscore are helpers and do not reach the output.
The value lists, ranges and weights below are fixed values; a value that
occurs more than once in a list counts that often.
"""

from quiltframe.plans.specs import (
    Ago, Coded, DaysAgo, Derived, Flag, Gauss, Maybe, Pick, Real, Sentence, Uniform, Uuid, Whole, Word,
)

DAY = 86_400
YEAR = 365 * DAY

# --- Fixed values ---------------------------------------------------------
PRODUCTS = ("Laptop", "Smartphone", "Headphones", "Monitor", "Keyboard", "Mouse", "Desk", "Chair")
CATEGORIES = ("Electronics", "Accessories", "Furniture")
REGIONS = ("North", "South", "East", "West", "Central")
DEPARTMENTS = ("Engineering", "Sales", "Marketing", "HR", "Finance", "Operations", "R&D")
POSITIONS = ("Intern", "Junior", "Mid-Level", "Senior", "Lead", "Manager", "Director", "VP")
EDUCATION = ("High School", "Bachelor", "Master", "PhD", "MBA")
GENDERS = ("Male", "Female", "Non-binary", "Prefer not to say")
CONDITIONS = ("Healthy", "Diabetes", "Hypertension", "Asthma", "Heart Disease", "Arthritis", "Cancer")
MEDICATIONS = ("None", "Metformin", "Lisinopril", "Albuterol", "Aspirin", "Insulin")
CURRENCIES = ("USD", "EUR", "GBP", "JPY", "INR")
LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
SERVICES = ("auth", "payment", "user", "order", "notification", "api-gateway", "database")
STATUS_CODES = (200, 201, 202, 400, 401, 403, 404, 500, 502, 503)
VEHICLE_TYPES = ("Car", "Truck", "Bus", "SUV", "Motorcycle", "Auto")
VEHICLE_STATES = ("WB", "JH", "BR", "UP", "DL", "MH", "KA", "TN", "AP", "KL", "GJ", "RJ")
VEHICLE_LETTERS = ("AB", "CD", "EF", "GH", "JK", "LM", "NP", "QR", "ST", "UV")
TOLL_PLAZAS = (
    "NH-16 Kolkata Toll Plaza", "NH-8 Delhi Toll Plaza", "NH-44 Chennai Toll Plaza",
    "NH-48 Mumbai Toll Plaza", "NH-7 Bangalore Toll Plaza",
)
DEVICE_TYPES = ("temperature", "humidity", "pressure", "motion", "light", "vibration", "gas")
SENSOR_STATUS = ("active", "active", "active", "idle", "maintenance")
VM_HOSTS = (
    "web-01", "web-02", "web-03", "api-01", "api-02", "db-01", "db-02", "cache-01",
    "worker-01", "worker-02",
)
DIRECTIONS = ("Northbound", "Southbound", "Eastbound", "Westbound")

# --- Common pieces --------------------------------------------------------
PHONE = Coded("", 2_000_000_000, 10_000_000_000)
ADDRESS_PARTS = {
    "_house": Whole(1, 1000), "_street": Word("STREETS"), "_town": Word("CITIES"),
    "_post": Coded("", 10000, 100000),
}
ADDRESS = Derived("concat(cast(_house as string), ' ', _street, ', ', _town, ' ', _post)")
PERSON = {"first_name": Word("FIRST_NAMES"), "last_name": Word("LAST_NAMES")}


def full_name(prefix):
    return Derived(f"concat({prefix}_first, ' ', {prefix}_last)")


PERSONAL = {
    "id": Uuid(),
    **PERSON,
    "_domain": Word("FREE_EMAIL_DOMAINS"),
    "email": Derived("concat(lower(first_name), '.', lower(last_name), '@', _domain)"),
    "phone": PHONE,
    **ADDRESS_PARTS,
    "address": ADDRESS,
    "city": Word("CITIES"),
    "state": Word("STATES"),
    "zipcode": Coded("", 10000, 100000),
    "birth_date": DaysAgo(18 * 365 + 5, 80 * 365 + 20),
    "age": Whole(18, 80),
    "gender": Pick(GENDERS),
    "occupation": Word("JOBS"),
    "income": Whole(20000, 250000),
    "marital_status": Pick(("Single", "Married", "Divorced", "Widowed")),
    "dependents": Whole(0, 5),
    "education": Pick(EDUCATION),
    "active": Flag(0.85),
    "created_at": Ago(2 * YEAR),
}

SALES = {
    "transaction_id": Uuid(),
    "customer_id": Uuid(),
    "product": Pick(PRODUCTS),
    "category": Pick(CATEGORIES),
    "quantity": Whole(1, 11),
    "_dear": Whole(500, 2000),
    "_middle": Whole(200, 800),
    "_cheap": Whole(20, 300),
    "unit_price": Derived(
        "case when product in ('Laptop', 'Smartphone') then _dear "
        "when product in ('Monitor', 'Desk', 'Chair') then _middle else _cheap end"),
    "total": Derived("unit_price * quantity"),
    "discount": Pick((0, 5, 10, 15, 20, 25, 30)),
    "payment_method": Pick(("Credit Card", "Debit Card", "PayPal", "UPI", "Net Banking")),
    "transaction_date": Ago(YEAR),
    **ADDRESS_PARTS,
    "shipping_address": ADDRESS,
    "shipping_method": Pick(("Standard", "Express", "Overnight", "Same Day")),
    "region": Pick(REGIONS),
    "rating": Whole(1, 6),
    "customer_rating": Real(1, 5, 1),
    "returned": Flag(0.05),
    "refund_status": Pick(("None", "None", "None", "Pending", "Completed"),
                          (0.7, 0.15, 0.07, 0.04, 0.04)),
}

EMPLOYEE = {
    "employee_id": Coded("EMP", 10000, 99999),
    **PERSON,
    "email": Derived("concat(lower(first_name), '.', lower(last_name), '@company.com')"),
    "department": Pick(DEPARTMENTS),
    "_level": Pick(POSITIONS),
    "position": Derived("concat(_level, ' ', department)"),
    "hire_date": DaysAgo(0, 3650),
    "salary": Whole(30000, 200000),
    "manager_id": Coded("EMP", 10000, 99999),
    "performance_rating": Real(1, 5, 1),
    "experience_years": Whole(0, 25),
    "education": Pick(EDUCATION),
    "remote_work": Flag(0.4),
    "bonus_eligible": Flag(0.6),
    "travel_percentage": Whole(0, 100),
    "projects_completed": Whole(0, 30),
    "certifications": Whole(0, 8),
    "termination_date": Maybe(DaysAgo(0, 730), 0.1),
}

# moving_avg_7d, moving_avg_30d and series_3 are windows over the series; the
# template builder adds them (see plans/templates.py).
TIME_SERIES = {
    "date": Derived("timestampadd(DAY, cast(row_id - {n} as int), "
                    "cast('{as_of}' as timestamp_ntz))"),
    "_noise": Gauss(0.0, 5.0),
    "value": Derived(
        "100e0 + case when {n} > 1 then 50e0 * row_id / ({n} - 1) else 0e0 end"
        " + 20e0 * sin(2 * pi() * row_id / 30) + 10e0 * sin(2 * pi() * row_id / 7)"
        " + 15e0 * sin(2 * pi() * row_id / 365) + _noise"),
    "_spread": Gauss(0.0, 2.0),
    "volatility": Derived("abs(_spread)"),
    "anomaly": Pick((0, 1), (0.95, 0.05)),
    "_noise_2": Gauss(0.0, 10.0),
    "series_2": Derived("50e0 + 0.5e0 * value + _noise_2"),
    "_step": Gauss(0.0, 1.0),
}

LOGS = {
    "timestamp": Ago(7 * DAY),
    "log_level": Pick(LOG_LEVELS),
    "service": Pick(SERVICES),
    "_source": Pick(SERVICES),
    "_sentence": Sentence(),
    "message": Derived("concat(_source, ': ', _sentence)"),
    "_ip1": Whole(1, 224), "_ip2": Whole(0, 256), "_ip3": Whole(0, 256), "_ip4": Whole(1, 255),
    "_has_ip": Flag(0.5),
    "source_ip": Derived("case when _has_ip then concat(cast(_ip1 as string), '.', "
                         "cast(_ip2 as string), '.', cast(_ip3 as string), '.', "
                         "cast(_ip4 as string)) end"),
    "user_id": Maybe(Uuid(), 0.3),
    "session_id": Maybe(Uuid(8), 0.3),
    "response_time_ms": Whole(10, 5000),
    "status_code": Pick(STATUS_CODES),
    "_page": Pick(("users", "orders", "products", "payments", "auth")),
    "endpoint": Derived("concat('/api/v1/', _page)"),
    "method": Pick(("GET", "POST", "PUT", "DELETE", "PATCH")),
    "bytes_sent": Whole(100, 1000000),
    "error_message": Maybe(Sentence(), 0.1),
}

SYSTEM = {
    "timestamp": Ago(7 * DAY),
    "hostname": Coded("host-", 1, 21, 2),
    "cpu_usage": Real(5, 95, 2),
    "memory_usage": Real(15, 90, 2),
    "disk_usage": Real(10, 98, 2),
    "network_in_mbps": Real(0.1, 200, 2),
    "network_out_mbps": Real(0.1, 150, 2),
    "load_avg_1min": Real(0, 5, 2),
    "load_avg_5min": Real(0, 4, 2),
    "load_avg_15min": Real(0, 3, 2),
    "process_count": Whole(30, 800),
    "uptime_hours": Whole(1, 8760),
    "temperature_celsius": Real(30, 75, 1),
    "power_consumption_watts": Whole(50, 1000),
    "open_file_descriptors": Whole(100, 65536),
}

VM = {
    "timestamp": Derived("cast('{as_of}' as timestamp_ntz) - row_id * interval '5' minute"),
    "hostname": Pick(VM_HOSTS),
    "has_issue": Flag(0.15),
    "_cpu": Uniform(10, 60),
    "_cpu_spike": Uniform(30, 70),
    "_memory": Uniform(30, 70),
    "_memory_spike": Uniform(20, 50),
    "cpu_usage": Derived("round(least(100e0, _cpu + case when has_issue then _cpu_spike "
                         "else 0e0 end), 2)"),
    "memory_usage": Derived("round(least(100e0, _memory + case when has_issue then _memory_spike "
                            "else 0e0 end), 2)"),
    "disk_usage": Real(20, 90, 2),
    "network_in_mbps": Real(1, 100, 2),
    "network_out_mbps": Real(1, 80, 2),
    "disk_read_ops": Whole(0, 2000),
    "disk_write_ops": Whole(0, 1000),
    "active_connections": Whole(10, 500),
    "running_processes": Whole(50, 400),
    "_issue": Pick(("High CPU", "Memory Leak", "Disk I/O", "Network Spike")),
    "issue_type": Derived("case when has_issue then _issue else 'None' end"),
}

IOT = {
    "timestamp": Ago(30 * DAY),
    "device_id": Coded("sensor-", 1, 101, 4),
    "device_type": Pick(DEVICE_TYPES),
    "_level": Uniform(0, 1),
    "_moving": Flag(0.3),
    "_motion": Whole(0, 100),
    "value": Derived(
        "round(case device_type when 'temperature' then 10e0 + _level * 30e0 "
        "when 'humidity' then 20e0 + _level * 70e0 when 'pressure' then 950e0 + _level * 80e0 "
        "when 'motion' then case when _moving then cast(_motion as double) else 0e0 end "
        "when 'light' then _level * 1000e0 when 'vibration' then _level * 2e0 "
        "else _level * 100e0 end, 2)"),
    "unit": Derived("case device_type when 'temperature' then '°C' when 'humidity' then '%' "
                    "when 'pressure' then 'hPa' when 'light' then 'lux' else 'mV' end"),
    "battery_level": Whole(5, 100),
    "signal_strength": Whole(1, 6),
    "location_lat": Real(-90, 90, 4),
    "location_lon": Real(-180, 180, 4),
    "status": Pick(SENSOR_STATUS),
    "_major": Whole(1, 3), "_minor": Whole(0, 9), "_patch": Whole(0, 20),
    "firmware_version": Derived("concat('v', cast(_major as string), '.', "
                                "cast(_minor as string), '.', cast(_patch as string))"),
}

HEALTHCARE = {
    "patient_id": Coded("P", 10000, 99999),
    **PERSON,
    "age": Whole(18, 90),
    "gender": Pick(("Male", "Female", "Other")),
    "weight_kg": Real(40, 150, 1),
    "height_cm": Real(140, 210, 1),
    "bmi": Real(16, 40, 1),
    "blood_pressure_sys": Whole(90, 200),
    "blood_pressure_dia": Whole(50, 130),
    "heart_rate": Whole(50, 120),
    "temperature_c": Real(35.5, 39.0, 1),
    "blood_sugar": Whole(60, 250),
    "cholesterol": Whole(120, 350),
    "condition": Pick(CONDITIONS),
    "diagnosis_date": DaysAgo(0, 1825),
    "medication": Pick(MEDICATIONS),
    "allergies": Pick(("None", "Pollen", "Peanuts", "Dairy", "Latex", "None", "None")),
    "emergency_contact": PHONE,
    "insurance_provider": Pick(("Aetna", "BlueCross", "Cigna", "Medicare", "United", "None")),
    "followup_required": Flag(0.3),
}

FINANCIAL = {
    "transaction_id": Uuid(),
    "account_id": Coded("ACC", 10000, 99999),
    "type": Pick(("Deposit", "Withdrawal", "Transfer", "Payment", "Investment", "Loan")),
    "amount": Real(10, 100000, 2),
    "currency": Pick(CURRENCIES),
    "exchange_rate": Real(0.5, 100, 2),
    "timestamp": Ago(YEAR),
    "status": Pick(("Pending", "Completed", "Completed", "Completed", "Failed"),
                   (0.05, 0.5, 0.25, 0.1, 0.1)),
    "description": Sentence(),
    "category": Pick(("Food", "Transport", "Entertainment", "Bills", "Shopping", "Healthcare",
                      "Education", "Investment")),
    "location": Word("CITIES"),
    "payment_channel": Pick(("Online", "Mobile", "ATM", "Branch", "UPI")),
    "reference_number": Coded("REF", 100000, 999999),
}

TOLL = {
    "Transaction_ID": Derived(
        "concat('TXN', replace(substring('{as_of}', 1, 10), '-', ''), "
        "case when row_id + 1 < 10000 then substring(cast(row_id + 10001 as string), 2, 4) "
        "else cast(row_id + 1 as string) end)"),
    "Toll_Plaza_ID": Coded("TP", 1, 50, 3),
    "Toll_Plaza_Name": Pick(TOLL_PLAZAS),
    "Lane_Number": Whole(1, 11),
    "Transaction_Date": Derived("substring('{as_of}', 1, 10)"),
    "_hour": Coded("", 0, 24, 2), "_minute": Coded("", 0, 60, 2), "_second": Coded("", 0, 60, 2),
    "Transaction_Time": Derived("concat(_hour, ':', _minute, ':', _second)"),
    "_vstate": Pick(VEHICLE_STATES), "_vnumber": Coded("", 10, 100, 2),
    "_vletters": Pick(VEHICLE_LETTERS), "_vtail": Coded("", 1000, 9999),
    "Vehicle_Number": Derived("concat(_vstate, _vnumber, _vletters, _vtail)"),
    # One type per vehicle number: a function of the number, not of the row.
    "_vslot": Derived("cast(conv(substring(md5(Vehicle_Number), 1, 7), 16, 10) as bigint) % 6"),
    "Vehicle_Type": Derived("case _vslot " + " ".join(
        f"when {i} then '{t}'" for i, t in enumerate(VEHICLE_TYPES)) + " end"),
    "Vehicle_Class": Pick(("Private", "Commercial", "Government")),
    "Vehicle_Brand": Pick(("Hyundai", "Tata", "Maruti", "Toyota", "Honda", "Ford", "Mahindra")),
    "Vehicle_Model": Pick(("Creta", "Swift", "Innova", "XUV700", "Scorpio", "Fortuner", "Aura")),
    "Vehicle_Color": Pick(("White", "Black", "Silver", "Red", "Blue", "Grey", "Orange")),
    "Registration_State": Pick(VEHICLE_STATES),
    "_owner_first": Word("FIRST_NAMES"), "_owner_last": Word("LAST_NAMES"),
    "Owner_Name": full_name("_owner"),
    "_driver_first": Word("FIRST_NAMES"), "_driver_last": Word("LAST_NAMES"),
    "Driver_Name": full_name("_driver"),
    "FASTag_ID": Coded("FT", 100_000_000_000, 999_999_999_999),
    "FASTag_Status": Pick(("Active", "Active", "Active", "Inactive", "Suspended")),
    "Toll_Amount": Real(20, 800, 2),
    "Payment_Mode": Pick(("FASTag", "UPI", "Cash", "Card", "QR Code")),
    "Payment_Status": Pick(("Success", "Success", "Success", "Success", "Failed"),
                           (0.7, 0.1, 0.1, 0.05, 0.05)),
    "Entry_Direction": Pick(DIRECTIONS),
    "Exit_Direction": Pick(DIRECTIONS),
    "Speed_kmph": Whole(5, 80),
    "Overloaded": Pick(("No", "No", "No", "Yes", "Yes"), (0.6, 0.15, 0.1, 0.1, 0.05)),
    "CCTV_Camera_ID": Coded("CCTV-", 1, 50, 2),
    "Booth_Operator_ID": Coded("OPR", 100, 999),
    "Remarks": Pick(("Normal Transaction", "Normal Transaction", "Normal Transaction",
                     "Overload Alert", "Speed Violation", "FASTag Error", "Manual Entry"),
                    (0.5, 0.2, 0.1, 0.07, 0.05, 0.04, 0.04)),
}

TEMPLATES = {
    "Personal/Customer Data": PERSONAL,
    "Sales Transactions": SALES,
    "Employee Records": EMPLOYEE,
    "Time Series Data": TIME_SERIES,
    "Application Logs": LOGS,
    "System Metrics": SYSTEM,
    "Correlated VM Data": VM,
    "IoT Sensor Data": IOT,
    "Healthcare Records": HEALTHCARE,
    "Financial Transactions": FINANCIAL,
    "Toll Plaza Data": TOLL,
}
