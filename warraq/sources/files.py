"""Files of a folder as passages and triples: discovery, parsing in batches, isolation of files that fail."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.functions import constants as C
from warraq.functions import text as T
from warraq.operators import passages as P

_SECTION = "title string, section string, type string, url string, body string, source string, `desc` string, heading string, keywords string, alt string, img string, updated string, rank double"
PARSED = f"path string, suffix string, docs array<struct<{_SECTION.replace(' string', ':string').replace(' double', ':double')}>>, triples array<struct<subject:string,predicate:string,object:string>>, error string"


def wanted(path: Column) -> Column:
    """A known suffix, no skipped folder anywhere, not below a top-level `scripts`, not a generated file."""
    parts = F.split(path, "/")
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    name = F.element_at(parts, -1)
    return suffix.isin(*C.SUFFIXES) & ~F.arrays_overlap(parts, F.array(*map(F.lit, C.SKIPPED_FOLDERS))) & (F.get(parts, F.lit(0)) != "scripts") & ~name.isin(*C.GENERATED_FILES)


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, content) of the files to parse."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    relative = F.expr(f"substring(path, locate({_sql(prefix)}, path) + {len(prefix)})")
    return files.select(F.url_decode(F.replace(relative, F.lit("+"), F.lit("%2B"))).alias("path"), "content").filter(wanted(F.col("path")))


def _sql(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def parse(files: DataFrame) -> DataFrame:
    """PARSED: a row for each file; one that fails has its error and nothing else."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from warraq.sources.parsers import parse_file

        for frame in frames:
            rows = []
            for path, url, content in zip(frame.path, frame.url, frame.content, strict=True):
                suffix = "." + path.rpartition(".")[2].lower()
                try:
                    docs, triples = parse_file(bytes(content), url, path)
                    rows.append((path, suffix, docs, [dict(zip(("subject", "predicate", "object"), t, strict=True)) for t in triples], None))
                except Exception as failure:  # any parser's error concerns its file alone
                    rows.append((path, suffix, [], [], f"{type(failure).__name__}: {failure}"))
            yield pd.DataFrame(rows, columns=["path", "suffix", "docs", "triples", "error"])

    return files.select("path", T.url_path("path").alias("url"), "content").mapInPandas(run, PARSED)


def collect(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(passages with doc_id and categories, triples with ord, counts by suffix and of skipped files)."""
    from warraq.operators.components import cut_lineage
    from warraq.operators.index import dense_ids

    parsed = cut_lineage(parse(read_folder(spark, root)))
    sections = parsed.select("path", F.posexplode("docs").alias("section_no", "d")).select("path", "section_no", "d.*")
    made = P.classify(P.make_passages(sections))
    numbered = dense_ids(made, ["path", "section_no", "passage_no"], "doc_id")
    triples = parsed.select("path", F.posexplode("triples").alias("n", "t")).select("path", "n", "t.*")
    counts = parsed.groupBy(F.when(F.col("error").isNull(), F.col("suffix")).otherwise("skipped").alias("kind")).agg(F.count("*").alias("n"))
    return P.deduplicate(numbered.drop("path", "section_no", "passage_no")), dense_ids(triples, ["path", "n"], "ord").drop("path", "n"), counts


def html_sections(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(the other columns, section_no, heading, body ...) of pages held in a table."""
    rest = [f for f in pages.schema.fields if f.name not in (html_col, url_col)]
    names = [f.name for f in rest]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from warraq.sources.parsers import parse_html

        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                docs, _ = parse_html(r[html_col] or "", r[url_col] or "", r[url_col] or "")
                rows += [{n: r[n] for n in names} | {"section_no": k} | d for k, d in enumerate(docs)]
            yield pd.DataFrame(rows, columns=[*names, "section_no", *(c.split()[0].strip("`") for c in _SECTION.split(", "))])

    return pages.mapInPandas(run, f"{schema}, section_no int, {_SECTION}")


def json_lines_flat(df: DataFrame, json_col: str, out_col: str = "line") -> DataFrame:
    """A row for each "path: value" line of a JSON column, by exploding a parsed variant one level at a time.

    Values that are false (null, false, 0, empty) are dropped; objects of one level only, deeper ones by the
    parser of whole files.
    """
    parsed = F.from_json(json_col, "map<string,string>")
    rows = df.select("*", F.posexplode(F.map_entries(parsed)).alias("line_no", "_e"))
    value = T.clean_text(F.col("_e.value"))
    return rows.filter(F.col("_e.key") != "@context").filter(~value.isin("", "0", "false", "0.0")).withColumn(out_col, F.concat(F.col("_e.key"), F.lit(": "), value)).drop("_e")


def csv_rows_as_passages(df: DataFrame, name: str, order: str) -> DataFrame:
    """A passage for each row of a table: "column: value — ...", empty cells left out."""
    cells = [F.when(T.clean_text(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), T.clean_text(F.col(c).cast("string")))) for c in df.columns]
    return df.select(F.col(order).alias("doc_id"), F.lit(name).alias("section"), F.concat_ws(" — ", *cells).alias("body"))
