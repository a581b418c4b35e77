"""Dashboard data: scatter, trend, correlation, histograms, gaps, outliers, comparisons."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltframe.functions.cells import col, count_if, is_missing, numeric_columns, present
from quiltframe.operators.fit import correlations
from quiltframe.operators.order_stats import exact_quantiles

HISTOGRAM_BINS, COMPARISON_BINS, TREND_POINTS = 30, 20, 100


def scatter(df: DataFrame, x: str, y: str, order_by: list[str], limit: int = 500) -> DataFrame:
    """The first rows of two columns, in a stated order."""
    return df.orderBy(*[col(o) for o in order_by]).limit(limit).select(
        *[col(o) for o in order_by if o not in (x, y)], col(x), col(y))


def linear_trend(df: DataFrame, x: str, y: str, points: int = TREND_POINTS) -> DataFrame:
    """(i, x, y): the least-squares line over all rows on an even grid of x."""
    fitted = df.agg(
        F.regr_slope(present(df, y), present(df, x)).alias("slope"),
        F.regr_intercept(present(df, y), present(df, x)).alias("intercept"),
        F.min(present(df, x)).cast("double").alias("low"),
        F.max(present(df, x)).cast("double").alias("high"))
    at = F.col("low") + (F.col("high") - F.col("low")) * F.col("i") / F.lit(float(points - 1))
    return fitted.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).select(
        "i", at.alias("x"), (F.col("intercept") + F.col("slope") * at).alias("y"))


def correlation_matrix(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(a, b, r) for every ordered pair of numeric columns."""
    return correlations(df, names or numeric_columns(df))


def _binned(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin number; the highest value belongs to the last bin."""
    width = (high - low) / F.lit(float(bins))
    return F.when(high > low, F.least(F.floor((value - low) / width).cast("int"), F.lit(bins - 1))) \
        .when(value.isNotNull(), F.lit(0))


def histogram(df: DataFrame, name: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, low, high, n, mean): every bin, empty ones included, and the column mean."""
    value = present(df, name).cast("double")
    edges = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"))
    grid = edges.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    placed = df.select(value.alias("v")).join(F.broadcast(edges))  # edges is one row
    counts = placed.where("v is not null").groupBy(
        _binned(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return grid.join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"), "mean")


def missing_values(df: DataFrame, limit: int | None = None) -> DataFrame:
    """(column, missing) of the columns with gaps, in table order; the first `limit` if given."""
    rows = [F.struct(F.lit(i).alias("at"), F.lit(n).alias("column"),
                     count_if(is_missing(df, n)).alias("missing"))
            for i, n in enumerate(df.columns)]
    found = df.agg(F.array(*rows).alias("rows")).select(F.inline("rows")).where("missing > 0").orderBy("at")
    return (found if limit is None else found.limit(limit)).select("column", "missing")


def type_counts(df: DataFrame) -> DataFrame:
    """(type, columns, cells): columns per data type and the present cells in them."""
    columns = [F.struct(F.lit(f.dataType.simpleString()).alias("type"),
                        count_if(~is_missing(df, f.name)).alias("cells")) for f in df.schema.fields]
    return df.agg(F.array(*columns).alias("rows")).select(F.inline("rows")).groupBy("type").agg(
        F.count(F.lit(1)).alias("columns"), F.sum("cells").alias("cells"))


def iqr_outliers(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, low, high, outliers): rows beyond 1.5 IQR of the quartiles."""
    names = numeric_columns(df) if names is None else names
    q = {(r["column"], r["p"]): r["value"]
         for r in exact_quantiles(df, names, [0.25, 0.75]).collect()}  # two numbers per column
    rows = []
    for n in names:
        q1, q3 = q[n, 0.25], q[n, 0.75]
        if q1 is None:
            continue
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        value = present(df, n)
        rows.append(F.struct(
            F.lit(n).alias("column"), F.lit(low).alias("low"), F.lit(high).alias("high"),
            count_if((value < low) | (value > high)).alias("outliers")))
    if not rows:
        return df.sparkSession.createDataFrame(
            [], "column string, low double, high double, outliers bigint")
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _ranked(df: DataFrame, aggregate, name: str, limit: int | None) -> DataFrame:
    rows = [F.struct(F.lit(n).alias("column"), aggregate(present(df, n)).alias(name))
            for n in numeric_columns(df)]
    ranked = df.agg(F.array(*rows).alias("rows")).select(F.inline("rows")).orderBy(
        F.desc_nulls_last(name), "column")
    return ranked if limit is None else ranked.limit(limit)


def top_deviations(df: DataFrame, limit: int | None = None) -> DataFrame:
    return _ranked(df, F.stddev_samp, "std", limit)


def top_variances(df: DataFrame, limit: int | None = None) -> DataFrame:
    return _ranked(df, F.var_samp, "variance", limit)


def box_summary(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, q1, median, q3, mean, std) of the named, or all numeric, columns."""
    names = numeric_columns(df) if names is None else names
    moments = df.agg(F.array(*[F.struct(
        F.lit(n).alias("column"), F.avg(present(df, n)).alias("mean"),
        F.stddev_samp(present(df, n)).alias("std")) for n in names]).alias("rows")
    ).select(F.inline("rows"))
    points = exact_quantiles(df, names, [0.25, 0.5, 0.75]).groupBy("column").agg(*[
        F.max(F.when(F.col("p") == p, F.col("value"))).alias(a)
        for p, a in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    return points.join(F.broadcast(moments), "column")  # one row per column


def _both(original: DataFrame, synthetic: DataFrame, names: list[str]) -> DataFrame:
    def tagged(df, source):
        return df.select(F.lit(source).alias("source"),
                         *[present(df, n).cast("double").alias(n) for n in names])

    return tagged(original, "original").unionByName(tagged(synthetic, "synthetic"))


def compare_distribution(original: DataFrame, synthetic: DataFrame, name: str,
                         bins: int = COMPARISON_BINS) -> DataFrame:
    """(source, bin, low, n): histograms of both tables over shared edges."""
    rows = _both(original, synthetic, [name])
    edges = rows.agg(F.min(col(name)).alias("lo"), F.max(col(name)).alias("hi"))
    placed = rows.where(col(name).isNotNull()).join(F.broadcast(edges))  # one row
    counts = placed.groupBy(
        "source", _binned(col(name), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = edges.select(
        "*", F.explode(F.array(F.lit("original"), F.lit("synthetic"))).alias("source")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    low = F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return grid.join(F.broadcast(counts), ["source", "bin"], "left").select(
        "source", "bin", low.alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def compare_statistics(original: DataFrame, synthetic: DataFrame,
                       names: list[str] | None = None) -> DataFrame:
    """(source, mean, std, min, max): mean of means, of deviations, lowest and highest value."""
    names = names or numeric_columns(original)

    def mean(columns):
        known = F.filter(F.array(*columns), lambda x: x.isNotNull())
        return F.when(F.size(known) > 0, F.aggregate(
            known, F.lit(0.0).cast("double"), lambda a, x: a + x) / F.size(known))

    rows = _both(original, synthetic, names).groupBy("source").agg(
        *[f(col(n)).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (
            ("a", F.avg), ("s", F.stddev_samp), ("l", F.min), ("h", F.max))])

    def group(k):
        return [F.col(f"{k}{i}") for i in range(len(names))]

    return rows.select("source", mean(group("a")).alias("mean"), mean(group("s")).alias("std"),
                       F.array_min(F.array(*group("l"))).alias("min"),
                       F.array_max(F.array(*group("h"))).alias("max"))


def compare_correlations(original: DataFrame, synthetic: DataFrame,
                         names: list[str] | None = None) -> DataFrame:
    """(a, b, r_original, r_synthetic) for every ordered pair."""
    names = names or numeric_columns(original)
    first = correlations(original, names).withColumnRenamed("r", "r_original")
    second = correlations(synthetic, names).withColumnRenamed("r", "r_synthetic")
    return first.join(F.broadcast(second), ["a", "b"])  # columns squared


def metric_percentages(report: DataFrame) -> DataFrame:
    """(metric, percent) of completeness, uniqueness and privacy from a quality report."""
    pairs = [F.struct(F.lit(m).alias("metric"), (F.col(m) * 100).alias("percent"))
             for m in ("completeness", "uniqueness", "privacy_score")]
    return report.select(F.inline(F.array(*pairs)))
