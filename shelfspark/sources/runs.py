"""Runs and their items as tables: append, complete, fail, sweep, read, export."""

from __future__ import annotations

import csv
import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PRODUCT_FIELDS, conform

RUNS = "id long, label string, source_url string, strategy_id long, strategy_name string, product_count long, status string, error_message string, diagnostics string, started_at timestamp, timestamp timestamp"
STALE_HOURS = 6


def start(label: str, url: Column | str, run_id: Column, at: Column, rows: DataFrame) -> DataFrame:
    """A running run for each row of `rows`."""
    null = lambda t: F.lit(None).cast(t)
    return rows.select(run_id.alias("id"), F.lit(label).alias("label"), (url if isinstance(url, Column) else F.lit(url)).alias("source_url"), null("long").alias("strategy_id"), null("string").alias("strategy_name"), F.lit(0).cast("long").alias("product_count"), F.lit("running").alias("status"), F.lit("").alias("error_message"), null("string").alias("diagnostics"), at.alias("started_at"), at.alias("timestamp"))


def complete(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs with `results` (id, strategy_name, product_count, diagnostics) become completed; the others stay."""
    r = results.select("id", *(F.col(c).alias(f"n_{c}") for c in ("strategy_name", "product_count", "diagnostics")), F.lit(True).alias("_done"))
    both = runs.join(r, "id", "left")
    pick = lambda c: F.when(F.col("_done"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    status = F.when(F.col("_done"), "completed").otherwise(F.col("status")).alias("status")
    return both.select(*(pick(c) if f"n_{c}" in both.columns else status if c == "status" else F.col(c) for c in runs.columns))


def fail(runs: DataFrame, errors: DataFrame) -> DataFrame:
    """Runs with `errors` (id, error) become failed, with the message's first 500 characters."""
    both = runs.join(errors.select("id", F.substring("error", 1, 500).alias("_e")), "id", "left")
    return both.withColumns({"status": F.when(F.col("_e").isNotNull(), "failed").otherwise(F.col("status")), "error_message": F.coalesce("_e", "error_message")}).select(runs.columns)


def sweep_stale(runs: DataFrame, now: Column, hours: int = STALE_HOURS) -> DataFrame:
    """Running runs that started more than `hours` before `now` are failed."""
    stale = (F.col("status") == "running") & (F.coalesce("started_at", "timestamp") < now - F.expr(f"INTERVAL {hours} HOURS"))
    return runs.withColumns({"status": F.when(stale, "failed").otherwise(F.col("status")), "error_message": F.when(stale, f"Run did not finish within {hours} hours.").otherwise(F.col("error_message"))})


def history(runs: DataFrame) -> DataFrame:
    return runs.drop("diagnostics").orderBy(F.desc("id"))


def rename(runs: DataFrame, names: DataFrame) -> DataFrame:
    """Runs with `names` (id, label) get the trimmed label; the others keep theirs."""
    both = runs.join(names.select("id", F.trim("label").alias("_label")), "id", "left")
    return both.withColumn("label", F.coalesce("_label", "label")).select(runs.columns)


def lookup(runs: DataFrame, items: DataFrame, wanted: DataFrame) -> DataFrame:
    """The runs of `wanted` (id) with their items in order, as one list each; an unknown id gives no row."""
    listed = items.groupBy(F.col("run_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", "product_name"))).alias("items"))  # a run's items are one page of an export
    return runs.join(wanted, "id", "left_semi").join(listed, "id", "left")


def decoded(runs: DataFrame, schema: str) -> DataFrame:
    """Runs with their diagnostics as a struct; text that is no JSON gives null."""
    return runs.withColumn("diagnostics", F.from_json("diagnostics", schema))


def delete(runs: DataFrame, items: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the runs of `ids` (id) and their items."""
    return runs.join(ids, "id", "left_anti"), items.join(ids.withColumnRenamed("id", "run_id"), "run_id", "left_anti")


def migrate(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both schemas; missing text columns are ''."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.fillna("", [f.name for f in both.schema.fields if f.dataType.simpleString() == "string"])


def save_items(items: DataFrame, path: str) -> None:
    """Append items below a folder for each run, so that one run's items are read alone."""
    items.write.mode("append").partitionBy("run_id").parquet(path)


def read_items(spark: SparkSession, path: str, run_id: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("run_id") == run_id)


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Targets from CSV: trimmed, with a scheme, without blank URLs."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    url = F.trim("url")
    full = F.when(url.rlike("(?i)^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    return raw.where(url != "").select(F.trim("label").alias("label"), full.alias("url"), F.trim("segment").alias("segment"), F.coalesce(F.trim("notes"), F.lit("")).alias("notes"))


def choose_targets(targets: DataFrame, segments: list[str] | None = None, labels: list[str] | None = None) -> DataFrame:
    for c, wanted in (("segment", segments), ("label", labels)):
        if wanted:
            targets = targets.where(F.lower(F.trim(c)).isin([x.strip().lower() for x in wanted]))
    return targets


def report(results: DataFrame, path: str) -> None:
    """Results as CSV and as JSON lines."""
    results.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    results.write.mode("overwrite").json(f"{path}/json")


#: Rows of one workbook: a sheet's own limit.
SHEET_ROWS = 1_048_575


def workbook(items: DataFrame, summary: dict[str, object], columns: list[str] = PRODUCT_FIELDS, limit: int = SHEET_ROWS) -> bytes:
    """One run as an .xlsx: a sheet of products with widths, frozen header and filter, and a summary sheet.

    A workbook is one file of one process and its sheet holds `limit` rows at most; more raise an error, larger
    exports go through `report`.
    """
    rows = [tuple(r) for r in conform(items, ("ord",)).orderBy("ord").select(columns).limit(limit + 1).toLocalIterator()]
    if len(rows) > limit:
        raise ValueError(f"a sheet holds {limit} rows; write CSV instead")

    def name(i: int) -> str:
        out = ""
        while i:
            i, r = divmod(i - 1, 26)
            out = chr(65 + r) + out
        return out

    def sheet(table: list[tuple], widths: list[int], top: str) -> str:
        cell = lambda r, c, v: f'<c r="{name(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape("".join(x for x in str(v) if x >= " " or x in chr(9) + chr(10)))}</t></is></c>'
        body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row, 1) if v not in (None, ""))}</row>' for r, row in enumerate(table, 1))
        cols = "".join(f'<col min="{c}" max="{c}" width="{w}" customWidth="1"/>' for c, w in enumerate(widths, 1))
        return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{top}<cols>{cols}</cols><sheetData>{body}</sheetData>{f"""<autoFilter ref="A1:{name(len(widths))}{max(1, len(table))}"/>""" if top else ""}</worksheet>'

    head = tuple(c.replace("_", " ").title() for c in columns)
    widths = [min(50, max(len(str(r[i])) for r in [head, *rows[:20]]) + 3) for i in range(len(columns))]
    frozen = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    parts = {
        "[Content_Types].xml": '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/worksheets/sheet2.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Products" sheetId="1" r:id="r1"/><sheet name="Summary" sheetId="2" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": sheet([head, *rows], widths, frozen),
        "xl/worksheets/sheet2.xml": sheet([(k, v) for k, v in summary.items()], [30, 30], ""),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def csv_text(rows: list[tuple], header: list[str]) -> str:
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(header)
    w.writerows(rows)
    return out.getvalue()


# --- answers of providers, kept by query ---------------------------------------------------------------------------
def query_key(provider: Column, query: Column) -> Column:
    return F.sha2(F.concat(provider, F.lit("::"), query), 256)


def from_cache(queries: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries with their kept payload, queries without one); `cache` has key and payload."""
    keyed = queries.withColumn("key", query_key(F.col("provider"), F.col("query")))
    return keyed.join(cache, "key"), keyed.join(cache, "key", "left_anti")


def available(providers: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """Providers that aren't cooling down; `state` has provider, status and until."""
    cooling = state.where(F.col("until") > now).select("provider").distinct()
    return providers.join(cooling, "provider", "left_anti")


def in_scope(cookies: DataFrame, host: Column) -> DataFrame:
    """Cookies whose domain is the host's or above it."""
    domain = F.regexp_replace(F.lower("domain"), r"^\.", "")
    return cookies.where((domain != "") & ((host == domain) | F.endswith(host, F.concat(F.lit("."), domain))))
