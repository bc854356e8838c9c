"""Metric facts: reading them from text or JSON, keeping one best row, looking them up."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.session import materialize
from shelfmark.functions.sizing import spread_rows
from shelfmark.functions.text import is_json, strip, strip_json_fence
from shelfmark.functions.windows import first_per_key

# Standard metric names, fact layout, text formats.
STANDARD_METRICS = ["收入", "净利润", "毛利率", "净利率", "市盈率", "EV/EBITDA", "市值", "同比增速", "市场份额"]
FACT_KEY = ["company", "metric", "year", "source_file"]
FACT_JSON = (
    "array<struct<company:string,ticker:string,metric:string,raw_metric:string,"
    "value:double,unit:string,year:string,is_estimate:int>>"
)
ESTIMATE_TAG = "（预测值）"
MIN_PAGE_CHARS = 100
#: Pages read by a task: their expressions take far longer than their bytes suggest.
PAGES_PER_TASK = 20_000
PERIOD = r"(?:19|20)\d{2}|FY\d{2}|[12]H\d{2}"
ESTIMATE_WORDS = "预计|预测"


def period_year(raw: Column) -> Column:
    """``2025E``, ``预计2025年`` to ``2025``; ``FY24`` and ``1H25`` stay; no period gives NULL."""
    return F.nullif(F.regexp_extract(raw, rf"({PERIOD})", 1), F.lit(""))


def period_is_estimate(raw: Column) -> Column:
    forecast = F.regexp_like(raw, F.lit(rf"{ESTIMATE_WORDS}|\d{{2}}E"))
    return F.when(forecast, 1).otherwise(0)


def number_value(raw: Column) -> Column:
    """The number as written, without thousands separators or percent sign; never rescaled."""
    return F.regexp_replace(F.regexp_extract(raw, r"-?\d[\d,]*(?:\.\d+)?", 0), ",", "").try_cast("double")


def number_unit(raw: Column) -> Column:
    """What follows the number; a percent sign alone stands for itself."""
    unit = strip(F.regexp_extract(raw, r"-?\d[\d,]*(?:\.\d+)?(.*)$", 1))
    return F.when(unit.startswith("%"), "%").otherwise(F.nullif(unit, F.lit("")))


def standard_metric(raw: Column) -> Column:
    """First standard metric named in ``raw``; other metrics keep their own name."""
    out = None
    for name in STANDARD_METRICS:
        hit = F.contains(raw, F.lit(name))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(raw)


def is_complete(facts: DataFrame) -> DataFrame:
    """Company, metric and year must all be there."""
    ok = F.lit(True)
    for c in ("company", "metric", "year"):
        ok = ok & (F.coalesce(F.col(c), F.lit("")) != "")
    return facts.filter(ok)


def facts_from_json(pages: DataFrame, json_col: str = "json") -> DataFrame:
    """Explode JSON arrays of facts; a page whose text is not valid JSON gives none."""
    rest = [c for c in pages.columns if c != json_col]
    clean = strip_json_fence(F.col(json_col))
    items = F.when(is_json(clean), F.from_json(clean, FACT_JSON))
    rows = pages.select(*rest, F.posexplode_outer(items).alias("fact_no", "f"))
    facts = rows.select(*rest, "fact_no", "f.*").withColumn("is_estimate", F.coalesce("is_estimate", F.lit(0)))
    return is_complete(facts)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out a single time per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _with_last_actual(read: Column) -> Column:
    """Adds to each clause, as ``before``, the period of the last one before it that names an actual (not forecast) one.

    The clauses are cut behind every actual period, so each is copied once.
    """
    def is_actual(i: Column) -> Column:
        p = F.get(read, i)["period"]
        return F.regexp_like(p, F.lit(PERIOD)) & ~F.regexp_like(p, F.lit(rf"{ESTIMATE_WORDS}|\d{{2}}E"))

    def cut(ends: Column) -> Column:
        def stretch(end: Column, k: Column) -> Column:
            n = F.coalesce(F.get(ends, k + 1), F.size(read) - 1) - end
            before = F.get(read, end)["period"].alias("before")
            return F.transform(F.slice(read, end + 2, n), lambda c: F.struct(c["period"].alias("period"), c["raw_metric"].alias("raw_metric"), c["number"].alias("number"), before))

        return F.flatten(F.transform(ends, stretch))

    return _once(F.concat(F.array(F.lit(-1)), F.filter(F.sequence(F.lit(0), F.size(read) - 1), is_actual)), cut)


def extract_facts(pages: DataFrame, text_col: str = "text", min_chars: int = MIN_PAGE_CHARS) -> DataFrame:
    """Read facts out of sentences such as ``<company><period><metric>为<number><unit>，...``.

    A clause without its own period takes the last actual (not forecast) one before it.
    ``fact_no`` is the number of the clause on its page. Adds ``fact_no, company, metric, raw_metric, value, unit, year, is_estimate``.
    """
    rest = [c for c in pages.columns if c != text_col]
    company = F.regexp_extract(
        F.col(text_col), rf"^(.*?)(?:{ESTIMATE_WORDS})?(?:(?:19|20)\d{{2}}E?年|FY\d{{2}}|[12]H\d{{2}})", 1
    )
    own_period = rf"^((?:{ESTIMATE_WORDS})?(?:(?:{PERIOD})E?年?(?:{ESTIMATE_WORDS})?)?)"
    shape = own_period + r"(\D+?)(?:为|达到|达|是)?(-?\d[\d,]*(?:\.\d+)?.*)$"
    long_enough = pages.filter(F.length(strip(F.col(text_col))) >= min_chars).withColumn("company", company)
    clauses = F.split(F.expr(f"substring({text_col}, length(company) + 1)"), "[，。；;]")
    read = F.transform(clauses, lambda c: F.struct(
        F.regexp_extract(c, own_period, 1).alias("period"), F.regexp_extract(c, shape, 2).alias("raw_metric"), F.regexp_extract(c, shape, 3).alias("number"),
    ))
    parsed = spread_rows(long_enough, PAGES_PER_TASK).select(
        *rest, "company", F.posexplode(_once(read, _with_last_actual)).alias("fact_no", "c")
    ).select(*rest, "company", "fact_no", "c.*").filter(F.col("number") != "")
    period = F.when(F.regexp_like("period", F.lit(PERIOD)), F.col("period")).otherwise(F.col("before"))
    facts = parsed.withColumn("period", period).select(
        *rest, "fact_no", "company",
        standard_metric(F.col("raw_metric")).alias("metric"),
        "raw_metric",
        number_value(F.col("number")).alias("value"),
        number_unit(F.col("number")).alias("unit"),
        period_year(F.col("period")).alias("year"),
        period_is_estimate(F.col("period")).alias("is_estimate"),
    )
    return is_complete(facts)


def best_fact(facts: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per company, metric, year: highest confidence, then lowest page, then arrival.

    A combinable aggregate, so a company holding a third of all facts is no bottleneck.
    """
    order = [-F.col("confidence"), F.col("source_page"), F.col(seq)]
    return first_per_key(facts, ["company", "metric", "year"], order)


def fact_lines(facts: DataFrame) -> Column:
    """Citation text of a fact with its source file and page."""
    tag = F.when(F.col("is_estimate") == 1, ESTIMATE_TAG).otherwise("")
    core = F.concat(
        F.col("company"), F.lit(" | "), F.col("metric"), tag, F.lit(" = "), F.col("value").cast("string"), F.lit(" "),
        F.coalesce("unit", F.lit("")), F.lit(" ["), F.col("year"), F.lit("]"),
    )
    page = F.concat(F.lit("第 "), F.col("source_page").cast("string"), F.lit(" 页"))
    origin = F.concat_ws(" · ", F.nullif("source_file", F.lit("")), page)
    return F.concat(core, F.when(origin != "", F.concat(F.lit("\n  📄 来源: "), origin)).otherwise(""))


class BadInput(ValueError):
    """The statement is not a plain query of the fact table."""


VIEW = "financial_metrics"
#: Settings that statements see as the caller has them.
_SHARED = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled", "spark.sql.adaptive.enabled")


class MetricBase:
    """The fact table, stored once, in a session of its own that knows nothing else.

    The caller's views do not exist in that session and files cannot be named in it, so a statement can reach the fact
    view and the tables of the catalogue only; the latter are refused by name before the statement is planned.
    """

    def __init__(self, facts: DataFrame):
        spark = facts.sparkSession
        self.stored = materialize(facts, "facts")
        self.session = spark.newSession()
        for key in _SHARED:
            self.session.conf.set(key, spark.conf.get(key))
        self.session.conf.set("spark.sql.runSQLOnFiles", "false")
        self.session.read.schema(facts.schema).parquet(self.stored.written_to).createOrReplaceTempView(VIEW)

    def query(self, sql: str, args: dict | None = None) -> DataFrame:
        """Run one read-only statement; :class:`BadInput` if it is anything else.

        It must begin with SELECT: a WITH could lead an INSERT. Every relation it names, in subqueries too, must be the
        fact view.
        """
        if not re.match(r"\s*SELECT\b", sql, re.IGNORECASE):
            raise BadInput("only SELECT is allowed")
        try:
            plan = self.session.sql(f"EXPLAIN EXTENDED {sql}", args=args).first()[0]
            parsed = plan.split("== Analyzed Logical Plan ==")[0]
            others = {n for n in re.findall(r"'UnresolvedRelation \[([^\]]*)\]", parsed) if n.lower() != VIEW}
            if others or "'UnresolvedTableValuedFunction" in parsed:
                raise BadInput(f"only {VIEW} can be read, not {', '.join(sorted(others)) or 'a table function'}")
            return self.session.sql(sql, args=args)
        except (ParseException, AnalysisException) as error:
            raise BadInput(str(error).splitlines()[0]) from error


def query_metrics(spark: SparkSession, facts: DataFrame | MetricBase, sql: str, args: dict | None = None) -> DataFrame:
    """Run one read-only statement over the view ``financial_metrics``; keep a :class:`MetricBase` to run several."""
    return (facts if isinstance(facts, MetricBase) else MetricBase(facts)).query(sql, args)
