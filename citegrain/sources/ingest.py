"""Reading turns, files, pages and event logs, and writing turns."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import DEFAULTS
from ..functions import text as T

MAX_BYTES = 5 * 1024 * 1024
SOURCE = "array<struct<url:string,title:string,domain:string,favicon:string,snippet:string>>"


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """Stored turns with typed sources: elements that are no objects go, a missing domain is the URL's."""
    return typed_turns(spark.read.parquet(path))


def typed_turns(turns: DataFrame) -> DataFrame:
    parsed = F.from_json(F.when(F.try_parse_json("sources").isNotNull(), F.col("sources")), SOURCE)
    kept = F.filter(F.coalesce(parsed, F.array().cast(SOURCE)), lambda s: s.isNotNull() & (T.text(s["url"]) != ""))
    with_domain = F.transform(kept, lambda s: s.withField("domain", F.coalesce(F.nullif(s["domain"], F.lit("")), s["url"])))
    return turns.withColumn("sources", with_domain)


def write_turns(turns: DataFrame, path: str, most: int = 20) -> None:
    """Finished turns by day, with the first sources and usage filled with zeros."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    done = turns.withColumn("sources", F.slice("sources", 1, most)).withColumn("day", F.to_date("created_at"))
    done.withColumns({c: zero(c) for c in ("total_tokens", "cost_usd") if c in turns.columns}).write.mode("append").partitionBy("day").parquet(path)


def cut(text, most: int = DEFAULTS.doc_chars):
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(f"\n\n[...truncated at {most} chars]"))).otherwise(text)


def read_docx(raw: bytes | None) -> str | None:
    mark = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    paragraphs = ("".join(t.text or "" for t in p.iter(mark + "t")) for p in root.iter(mark + "p"))
    return "\n".join(p for p in paragraphs if p.strip())


def docx_text(content: Column) -> Column:
    """Non-blank paragraphs of a DOCX file, or null if it can't be read."""

    @F.pandas_udf("string")
    def read(files: pd.Series) -> pd.Series:
        return files.map(read_docx)

    return read(content)


def ingest_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, mime, size, text, n_chars, error) of every file below a folder; no file fails the job."""
    return extract_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def extract_files(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    plain = F.make_valid_utf8(F.col("content").cast("string"))
    rows = files.select("path", name.alias("name"), T.mime_for_filename(name).alias("mime"), F.col("length").alias("size"), ext.alias("ext"), "content")
    text = F.when(F.col("ext").isin(".txt", ".md"), plain).when(F.col("ext") == ".docx", docx_text(F.when(F.col("ext") == ".docx", F.col("content"))))
    rows = rows.withColumn("text", F.when(F.col("size") <= MAX_BYTES, cut(F.trim(text))))
    error = F.when(F.col("size") > MAX_BYTES, "file too large").when(~F.col("ext").isin(".txt", ".md", ".docx"), F.concat(F.lit("unsupported type "), F.col("ext"))).when(F.col("text").isNull(), "unreadable file").when(F.col("text") == "", "no text")
    return rows.select("path", "name", "mime", "size", "text", F.length("text").alias("n_chars"), error.alias("error"))


class MainText(HTMLParser):
    """Text of a page without scripts, styles, navigation and comments."""

    SKIPPED = frozenset("script style nav header footer aside noscript form iframe svg template button".split())
    BLOCKS = frozenset("p div section article li tr table h1 h2 h3 h4 h5 h6 br ul ol blockquote pre td th main".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skipping: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.skipping.append(tag)
        elif tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if self.skipping and tag == self.skipping[-1]:
            self.skipping.pop()
        elif tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.skipping:
            self.parts.append(data)


def main_text(html: str | None) -> str | None:
    parser = MainText()
    parser.feed(html or "")
    parser.close()
    lines = (re.sub(r"[ \t]+", " ", line).strip() for line in "".join(parser.parts).split("\n"))
    text = "\n".join(line for line in lines if line)
    return text if len(text) > 50 else None


def extract_pages(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(page_id, url, text, columns of `keep`): main text of pages; null where 50 characters or fewer are left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(text=pdf["html"].map(main_text))[["page_id", "url", "text", *keep]]

    schema = StructType([*StructType.fromDDL("page_id bigint, url string, text string"), *(pages.schema[c] for c in keep)])
    return pages.select("page_id", "url", "html", *keep).mapInPandas(run, schema)


def read_sse(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, type, payload) of event logs as text: an event line names the data line after it."""
    return parse_sse(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value")))


def parse_sse(logs: DataFrame, key: str = "path") -> DataFrame:
    blocks = logs.select(key, F.posexplode(F.split("value", r"\r?\n\r?\n")).alias("seq", "block"))
    kind, data = F.regexp_extract("block", r"(?m)^event: ?(\S+)\s*$", 1), F.regexp_extract("block", r"(?m)^data: ?(.*)$", 1)
    return blocks.select(key, "seq", kind.alias("type"), data.alias("payload")).where((F.col("type") != "") & F.try_parse_json("payload").isNotNull())


def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine): rows outside the limits go to quarantine with their reasons."""
    n = lambda c: F.length(T.text(F.col(c)))
    rules = {
        "query": ("query length", lambda: (n("query") < 1) | (n("query") > 2000)), "iterations": ("iterations", lambda: ~F.col("iterations").between(1, 5)), "history": ("history length", lambda: F.size("history") > 20),
        "documents": ("documents", lambda: F.size("documents") > 5), "doc_text": ("document text length", lambda: n("doc_text") > 16_000), "name": ("name length", lambda: n("name") > 255), "note": ("note length", lambda: (n("note") < 1) | (n("note") > 10_000)),
    }
    reasons = F.array_compact(F.array(*[F.when(broken(), told) for c, (told, broken) in rules.items() if c in requests.columns]))
    judged = requests.withColumn("reasons", reasons)
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)
