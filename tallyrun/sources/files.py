"""Files as DataFrames: postings, JSON lines, a registry in CSV.  Nothing passes through the driver but counts of faults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.urls import company_from_host

# The columns of a posting, and of the public registry with the one that is personal.
POSTING_COLUMNS = (
    "company_name", "company_website_url", "linkedin_company_url", "linkedin_job_url", "external_apply_url", "job_title", "job_location", "career_root_url", "source",
)
OLD_COLUMNS = ("linkedin_job_title", "linkedin_job_location", "career_page_url")
LOCATORS = ("company_website_url", "linkedin_company_url", "linkedin_job_url", "external_apply_url")
REGISTRY_COLUMNS = ("Domain name", "Domain type", "Organization name", "Suborganization name", "City", "State", "Security contact email")
PERSONAL_COLUMN = "Security contact email"


class BadInput(ValueError):
    """A file breaks its contract."""


def read_postings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of JSON files that hold an array of postings or an object with ``postings``; columns that are not known are left out."""
    own = [StructField(c, StringType()) for c in (*POSTING_COLUMNS, *OLD_COLUMNS)]
    rows = spark.read.schema(StructType([*own, StructField("postings", ArrayType(StructType(own)))])).option("multiLine", True).option("mode", "FAILFAST").json(path)
    names = [f.name for f in own]
    wrapped = rows.filter("postings is not null").select(F.explode("postings").alias("p")).select(*[F.col(f"p.{c}").alias(c) for c in names])
    return rows.filter("postings is null").select(*names).unionByName(wrapped)


def as_inputs(rows: DataFrame) -> DataFrame:
    """Postings or earlier results as inputs: old names resolved, a missing company named after its website, and ``problem``: no_locator or null."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    filled = {c: F.nullif(has(c), F.lit("")) for c in POSTING_COLUMNS}
    filled["job_title"] = F.coalesce(has("job_title"), has("linkedin_job_title"))
    filled["job_location"] = F.coalesce(has("job_location"), has("linkedin_job_location"))
    filled["career_root_url"] = F.coalesce(filled["career_root_url"], F.nullif(has("career_page_url"), F.lit("")))
    filled["company_name"] = F.coalesce(filled["company_name"], company_from_host(has("company_website_url")))
    located = reduce(lambda a, b: a | b, [filled[c].isNotNull() for c in LOCATORS])
    return rows.select(*[v.alias(c) for c, v in filled.items()], F.when(~located, "no_locator").alias("problem"))


def sound_inputs(rows: DataFrame) -> DataFrame:
    """``as_inputs`` without the problem column; raises where a row has one."""
    found = as_inputs(rows)
    bad = found.filter("problem is not null").count()
    if bad:
        raise BadInput(f"{bad} records have no website, profile, posting or link to apply")
    return found.drop("problem")


def _unquoted(line: Column) -> Column:
    """A JSON text without its whole strings; what follows a quote is an open string."""
    return F.regexp_replace(F.regexp_replace(line, r"\\.", ""), r'"[^"]*"', "")


def _depth(line: Column) -> Column:
    """How many brackets are open at the end."""
    outside = F.regexp_replace(_unquoted(line), r'(?s)".*$', "")
    return F.length(F.regexp_replace(outside, r"[^\[{]", "")) - F.length(F.regexp_replace(outside, r"[^\]}]", ""))


def completable(line: Column) -> Column:
    """Whether a text that is no JSON could become an object by adding to its end: it starts one, and a string or a bracket is still open."""
    return F.ltrim(line).startswith("{") & (_unquoted(line).contains('"') | (_depth(line) > 0))


def _trailing(line: Column) -> Column:
    """Whether something follows the first value, which the JSON reader itself would pass over."""
    return (_depth(line) != 0) | ~F.rtrim(line).endswith("}") | _unquoted(line).rlike(r"\}\s*\{")


def read_json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Rows of JSON lines.  A file's last line may be cut off, if no line break follows; any other broken or blank line raises."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})).withColumn("broken", F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | _trailing(F.col("value")))
    place = F.struct("block", "at")
    files = parsed.groupBy("file").agg(
        F.count_if("broken").alias("broken"), F.max(place).alias("last"), F.max(F.when(F.col("broken"), place)).alias("last_broken"),
        (F.sum(F.octet_length("value") + 1) == F.max("size") + 1).alias("open_end"), F.max_by("value", place).alias("tail"),
    )
    torn = (F.col("broken") == 1) & (F.col("last") == F.col("last_broken")) & F.col("open_end") & completable(F.col("tail"))
    bad = files.filter((F.col("broken") > 0) & ~torn).select(F.sum("broken")).first()[0]
    if bad:
        raise BadInput(f"{bad} broken lines")
    return parsed.filter(~F.col("broken")).select("r.*").drop("_corrupt_record")


def read_registry(spark: SparkSession, path: str, most_rows: int = 100_000) -> DataFrame:
    """The public columns of a registry of domains in CSV, names in lower case.

    Raises unless the header is exactly the known one, every row is whole with a sound domain, type and organization, no domain repeats, and
    there are at most ``most_rows``, the registry's stated limit.
    """
    text = lambda names: StructType([StructField(c, StringType()) for c in names])
    header = spark.read.schema(text(f"c{i}" for i in range(len(REGISTRY_COLUMNS) + 1))).option("header", False).csv(path).limit(1).collect()
    if not header or tuple(header[0])[:-1] != REGISTRY_COLUMNS or header[0][-1] is not None:
        raise BadInput("schema_mismatch")
    rows = spark.read.schema(text(REGISTRY_COLUMNS)).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("multiLine", True).option("escape", "\"").csv(path)
    public = [c for c in REGISTRY_COLUMNS if c != PERSONAL_COLUMN]
    found = rows.select(*[(F.lower(F.trim(c)) if c == "Domain name" else F.trim(c)).alias(c.lower().replace(" ", "_")) for c in public])
    sound = F.col("domain_name").rlike(r"^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}$")
    n, distinct, bad_domain, bad_row = found.agg(
        F.count("*"), F.countDistinct("domain_name"), F.count_if(~F.coalesce(sound, F.lit(False))), F.count_if((F.coalesce("domain_type", F.lit("")) == "") | (F.coalesce("organization_name", F.lit("")) == ""))
    ).first()
    for fault, holds in (("empty_dataset", not n), ("row_limit_exceeded", n > most_rows), ("invalid_domain", bad_domain), ("malformed_row", bad_row), ("domain_collision", distinct < n)):
        if holds:
            raise BadInput(fault)
    return found


def regex_records(lines: DataFrame, text: str, marker: str, fields: dict[str, str]) -> DataFrame:
    """Records of documents (a text a row) that start with ``marker``: each field is the first group of its pattern, null where it is absent."""
    parts = lines.select(F.explode(F.slice(F.split(F.concat(F.lit("\n"), F.col(text)), marker), 2, 2**31 - 1)).alias("part"))
    value: dict[str, Column] = {name: F.nullif(F.trim(F.regexp_extract("part", pattern, 1)), F.lit("")) for name, pattern in fields.items()}
    return parts.select(*[c.alias(name) for name, c in value.items()])
