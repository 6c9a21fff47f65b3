"""From document text to lines, sections, chunks and table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dossier.functions.phrases import hits

#: Line shapes that open a section, and shapes of a clause reference.
HEADINGS = [r"^\d+\.\s+[A-Z]", r"^\d+\.\d+\s+[A-Z]", r"^\d+\.\d+\.\d+\s+[A-Z]", r"^(Clause|Section|Article|Part|Schedule)\s+\d+", r"^[A-Z][A-Z\s]{5,50}$", r"^(SCOPE|PAYMENT|LIABILITY|INSURANCE|TERMINATION|PENALTY|LIQUIDATED)"]
REFERENCES = [r"(?i)(clause\s+[\d.]+)", r"(?i)(section\s+[\d.]+)", r"(?i)(article\s+[\d.]+)", r"(?i)(para(?:graph)?\s+[\d.]+)", r"(\d+\.\d+(?:\.\d+)*)"]


def numbered_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each line that is not blank: doc, line_no (from 0, blank lines counted), text. Null texts have none."""
    rows = docs.select(doc, F.posexplode(F.split(text, "\n")).alias("line_no", "text"))
    return rows.where(F.trim("text") != "")


def estimated_page(line_no: Column, per_page: int = 40) -> Column:
    return (F.floor(line_no / per_page) + 1).cast("int")


def is_heading(text: Column, patterns: list[str] = HEADINGS, longest: int = 200, size: Column | None = None, bold: Column | None = None) -> Column:
    """Whether a line reads as a heading: by shape, or by size over 13 or bold where those are known."""
    line = F.trim(text)
    out = F.lit(False)
    for p in patterns:
        out = out | F.rlike(line, F.lit(p))
    if size is not None:
        out = out | F.coalesce(size > 13, F.lit(False))
    if bold is not None:
        out = out | (F.coalesce(bold, F.lit(False)) & (F.length(line) < 120))
    return (F.length(line).between(1, longest)) & out


def sections(lines: DataFrame, heading: Column, doc: str = "doc_id") -> DataFrame:
    """Sections of lines (doc, line_no, page_no, text): section_no, heading, page_no of the first line, text of the rest.

    A heading opens a section; lines before the first one belong to "Preamble", number 0.
    """
    w = W.partitionBy(doc).orderBy("line_no")
    rows = lines.withColumn("_h", heading).withColumn("section_no", F.sum(F.col("_h").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    body = F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("line_no", "text"))))
    return rows.groupBy(doc, "section_no").agg(F.coalesce(F.max(F.when(F.col("_h"), F.trim("text"))), F.lit("Preamble")).alias("heading"), F.min_by("page_no", "line_no").alias("page_no"), F.array_join(F.transform(body, lambda x: x["text"]), "\n").alias("text"), F.count_if(~F.col("_h")).alias("n_lines"))


def clause_reference(heading: Column) -> Column:
    """The first shape of REFERENCES found in a heading, else its first 60 characters."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(heading, p, 1)), F.lit("")) for p in REFERENCES], F.substring(heading, 1, 60))


def chunk_id(doc: Column, page: Column, text: Column) -> Column:
    """doc_page_ and 8 hex digits of an md5 of both and the first 80 characters."""
    return F.concat_ws("_", doc.cast("string"), page.cast("string"), F.substring(F.md5(F.concat(doc.cast("string"), page.cast("string"), F.substring(text, 1, 80))), 1, 8))


def capped_chunks(lines: DataFrame, keys: list[str], cap: int = 1800) -> DataFrame:
    """Chunks of each key's lines in order: emitted once `cap` characters are buffered, and cut to it; the rest at the end."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buffer"))

    def add(acc: Column, line: Column) -> Column:
        grown = F.when(acc["buffer"] == "", line).otherwise(F.concat(acc["buffer"], F.lit("\n"), line))
        full = F.length(grown) >= cap
        return F.struct(F.when(full, F.array_append(acc["out"], F.substring(grown, 1, cap))).otherwise(acc["out"]).alias("out"), F.when(full, "").otherwise(grown).alias("buffer"))

    folded = F.aggregate(ordered, start, add, lambda acc: F.when(acc["buffer"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["buffer"])))
    return lines.groupBy(*keys).agg(folded.alias("chunks")).select(*keys, F.posexplode("chunks").alias("chunk_no", "text"))


def blocks(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Runs of pipe rows (kind table) and of other lines (kind text): block_no from 0, text."""
    w = W.partitionBy(doc).orderBy("line_no")
    rows = lines.withColumn("_t", F.startswith(F.trim("text"), F.lit("|")))
    rows = rows.withColumn("_new", F.coalesce(F.col("_t") != F.lag("_t").over(w), F.lit(False)).cast("long")).withColumn("block_no", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(doc, "block_no").agg(F.when(F.max("_t"), "table").otherwise("text").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))


def cells(row: Column) -> Column:
    """Cells of a pipe row, trimmed, blank ones gone."""
    return F.filter(F.transform(F.split(row, r"\|"), lambda c: F.trim(c)), lambda c: c != "")


def table_to_plain(table: Column) -> Column:
    """Rows of a pipe table as text: separator rows and blank cells go, cells are joined by a bar."""
    rows = F.filter(F.split(table, "\n"), lambda r: ~F.rlike(r, F.lit(r"^[\s|:-]+$")))
    return F.array_join(F.transform(rows, lambda r: F.array_join(cells(r), " | ")), "\n")


def criteria_rows(tables: DataFrame, text: str = "text") -> DataFrame:
    """item_code, parameter and criteria_text of table rows whose first of three or more cells is an integer from 1 to 25."""
    keys = [c for c in tables.columns if c != text]
    rows = tables.select(*keys, F.posexplode(F.split(text, "\n")).alias("row_no", "_row")).withColumn("_cells", cells(F.col("_row")))
    code = F.get("_cells", F.lit(0))
    return rows.where((F.size("_cells") >= 3) & F.rlike(code, F.lit(r"^\d{1,2}$"))).where(code.try_cast("int").between(1, 25)).select(*keys, "row_no", code.alias("item_code"), F.get("_cells", F.lit(1)).alias("parameter"), F.array_join(F.slice("_cells", 3, 50), " ").alias("criteria_text"))


def table_chunks(rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """[TABLE n] chunks of table rows (doc, table_no, row_no, cells): blank cells and empty rows go, short tables too."""
    line = F.array_join(F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: c != ""), " | ")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "_line"))), lambda x: x["_line"])
    got = rows.withColumn("_line", line).where("_line <> ''").groupBy(doc, "table_no").agg(F.array_join(lines, "\n").alias("body"))
    return got.where(F.length("body") > 30).select(doc, "table_no", F.concat(F.lit("[TABLE "), F.col("table_no").cast("string"), F.lit("]\n"), F.col("body")).alias("text"))


def thin_pages(lines: DataFrame, headers: list[str], doc: str = "doc_id", least: int = 150) -> DataFrame:
    """Pages with the length of their text without header lines, and whether it is below `least`."""
    header = F.lit(False)
    for p in headers:
        header = header | F.rlike(F.lower("text"), F.lit(p))
    return lines.groupBy(doc, "page_no").agg(F.sum(F.when(header, 0).otherwise(F.length(F.trim("text")))).alias("real_chars")).withColumn("thin", F.col("real_chars") < least)


def filled(pages: DataFrame, other: DataFrame, keys: list[str], least: int = 80) -> DataFrame:
    """pages (text) with other's text where their own is shorter than `least` and the other longer."""
    b = other.select(*keys, F.col("text").alias("_other"))
    own = F.length(F.coalesce("text", F.lit("")))
    return pages.join(b, keys, "left").withColumn("text", F.when((own < least) & (F.length("_other") > own), F.col("_other")).otherwise(F.col("text"))).drop("_other")


def repaired(pages: DataFrame, corrected: DataFrame, keys: list[str], subjects: str, errors: str) -> DataFrame:
    """pages with candidate (a subject word, and an error sign or over 300 characters) and text: the corrected one if a candidate and half to twice as long."""
    b = corrected.select(*keys, F.col("text").alias("_new"))
    got = pages.withColumn("candidate", F.rlike(F.lower("text"), F.lit(subjects)) & (F.rlike("text", F.lit(errors)) | (F.length("text") > 300))).join(b, keys, "left")
    fits = F.col("candidate") & F.length("_new").between(F.length("text") * 0.5, F.length("text") * 2)
    return got.withColumn("text", F.when(fits, F.col("_new")).otherwise(F.col("text"))).drop("_new")


def term_coverage(chunks: DataFrame, terms: DataFrame, pages: int = 5) -> DataFrame:
    """For each term (term): chunks that hold it and the first pages, in one pass over a chunk (see phrases.hits)."""
    met = hits(chunks.select("page_no", F.lower("text").alias("_t")), F.col("_t"), terms.select(F.col("term").alias("label"), F.lit(0).alias("place"), F.lower("term").alias("phrase")).distinct())
    # Distinct pages first, so that no term's aggregate holds more than its pages, and of these only the first.
    by_page = met.groupBy(F.col("label").alias("term"), "page_no").agg(F.count("*").alias("n"))
    ranked = by_page.withColumn("_k", F.row_number().over(W.partitionBy("term").orderBy(F.asc_nulls_last("page_no"))))
    found = ranked.groupBy("term").agg(F.sum("n").alias("n_chunks"), F.array_sort(F.collect_list(F.when(F.col("_k") <= pages, F.col("page_no")))).alias("pages"))
    return terms.join(found, "term", "left").select("term", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("pages", F.array().cast("array<int>")).alias("pages"))


def table_inventory(tables: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Tables of each document: number, the longest, and fewest, most and mean bars."""
    bars = F.length("text") - F.length(F.replace(F.col("text"), F.lit("|"), F.lit("")))
    got = tables.withColumn("_bars", bars)
    return got.groupBy(doc).agg(F.count("*").alias("n_tables"), F.max_by("block_no", F.struct(F.length("text"), -F.col("block_no"))).alias("longest"), F.min("_bars").alias("min_bars"), F.max("_bars").alias("max_bars"), F.avg("_bars").alias("mean_bars"))
