"""File sources: a dispatcher by extension over binary files, with optional parsers for office formats."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import FEW_CHARS, ODD_SHARE, PICTURE_CHARS, markdown_paragraphs
from ..session import ship
from .semi import _leaves

MARKDOWN, IMAGES = ("md", "txt"), ("png", "jpg", "jpeg", "webp", "bmp")
#: block_type, text, page, section_path and a table's cells if there is one.
BLOCK = "path string, pos int, block_type string, text string, page int, section_path array<string>, table_data array<array<string>>, bbox array<double>"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, ext and content of every file below folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return df.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"), "content")


def markdown_blocks(found: DataFrame) -> DataFrame:
    """Blocks of md and txt files: paragraphs, headings and fenced code; bytes that aren't UTF-8 are dropped."""
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    lines = found.filter(F.col("ext").isin(*MARKDOWN)).select(F.col("path").alias("doc"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    blocks = markdown_paragraphs(lines)
    return blocks.select(F.col("doc").alias("path"), "pos", F.col("kind").alias("block_type"), "text", F.lit(1).alias("page"), "section_path", F.lit(None).cast("array<array<string>>").alias("table_data"), F.lit(None).cast("array<double>").alias("bbox"))


def _docx(content: bytes) -> Iterator[tuple]:
    import docx  # optional

    document, section = docx.Document(io.BytesIO(content)), []
    for p in document.paragraphs:
        if p.text.strip():
            heading = p.style.name.startswith("Heading")
            section = [p.text.strip()] if heading else section
            yield "heading" if heading else "paragraph", p.text.strip(), 1, list(section), None
    for t in document.tables:  # after all paragraphs
        cells = [[c.text.strip() for c in row.cells] for row in t.rows]
        yield "table", "\n".join("| " + " | ".join(r) + " |" for r in cells), 1, list(section), cells


#: How a heading of a page begins; characters of a whole file below which its text isn't taken for all there is.
PAGE_HEADING, LEAST_CHARS = re.compile(r"(Article|Section|Clause|Chapter|Part|\d+\.|\d+\.\d+)", re.I), 100


def page_blocks(pages: Iterator[tuple[int, list[tuple]]]) -> Iterator[tuple]:
    """Blocks of pages (number, [(x0, y0, x1, y1, text)]): a short one that begins like a heading names the section of what
    follows, over page ends too."""
    section: list[str] = []
    for n, own in pages:
        for x0, y0, x1, y1, text in own:
            text = text.strip()
            if not text:
                continue
            heading = text.count("\n") < 2 and len(text) < 120 and PAGE_HEADING.match(text) is not None
            section = [text] if heading else section
            yield "heading" if heading else "paragraph", text, n, list(section), None, [round(v, 2) for v in (x0, y0, x1, y1)]


def needs_ocr(area: float, text: str, images: int) -> bool:
    """Whether a page's own text won't do: the rules of chunking.ocr_gate()."""
    odd = sum(not c.isprintable() and not c.isspace() for c in text) / max(len(text), 1)
    return area <= 0 or len(text) < FEW_CHARS or odd > ODD_SHARE or (images >= 1 and len(text) < PICTURE_CHARS)


def scanned(pages: list[tuple[int, float, int, list[tuple]]], ocr: Callable[[int], str] | None) -> list[tuple[int, list[tuple]]]:
    """(number, blocks) of pages (number, area, images, blocks): their own text if the file has LEAST_CHARS of it, else with that of
    an OCR function on pages that need it; a file without any text is an error, so that nothing is indexed empty."""
    whole = lambda own: "".join(b[4] for b in own)
    if sum(len(whole(own).strip()) for *_, own in pages) < LEAST_CHARS and ocr is not None:
        pages = [(n, area, images, [(0.0, 0.0, 0.0, 0.0, ocr(n))] if needs_ocr(area, whole(own), images) else own) for n, area, images, own in pages]
    if not any(whole(own).strip() for *_, own in pages):
        raise ValueError("a scanned file without text")
    return [(n, own) for n, _, _, own in pages]


def _pdf(content: bytes, ocr: Callable[[bytes], str] | None = None) -> Iterator[tuple]:
    import fitz  # optional

    with fitz.open(stream=content, filetype="pdf") as pdf:
        pages = [(n, page.rect.width * page.rect.height, len(page.get_images()), [b[:5] for b in page.get_text("blocks")]) for n, page in enumerate(pdf, 1)]
        yield from page_blocks(iter(scanned(pages, (lambda n: ocr(pdf[n - 1].get_pixmap().tobytes("png"))) if ocr else None)))


def _json(content: bytes) -> Iterator[tuple]:
    for path, value in _leaves(json.loads(content), "root"):
        yield "clause", f"**{path}**: {value}", 1, [path], None


PARSERS: dict[str, Callable[[bytes], Iterator[tuple]]] = {"json": _json, "docx": _docx, "pdf": _pdf}


def other_blocks(found: DataFrame, ocr: Callable[[bytes], str] | None = None) -> DataFrame:
    """Blocks of json, docx and pdf files and, with an OCR function, of images; a file that can't be read gives one block
    of type `error` with the reason, so that nothing is indexed empty without notice."""
    parsers = PARSERS | ({e: lambda c: iter([("paragraph", ocr(c), 1, [], None)]) for e in IMAGES} | {"pdf": lambda c: _pdf(c, ocr)} if ocr else {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, ext, content in zip(batch["path"], batch["ext"], batch["content"], strict=True):
                try:
                    if ext not in parsers:
                        raise ValueError(f"no parser for .{ext}")
                    got = [(path, i, *b) for i, b in enumerate(parsers[ext](content))]
                    rows += [r if len(r) == 8 else (*r, None) for r in got] or [(path, 0, "error", "no text", 1, [], None, None)]
                except Exception as e:  # noqa: BLE001  a file's fault is its own
                    rows.append((path, 0, "error", f"{type(e).__name__}: {e}"[:300], 1, [], None, None))
            yield pd.DataFrame(rows, columns=["path", "pos", "block_type", "text", "page", "section_path", "table_data", "bbox"])

    return found.filter(~F.col("ext").isin(*MARKDOWN)).select("path", "ext", "content").mapInPandas(run, BLOCK)


def read_blocks(spark: SparkSession, folder: str, ocr: Callable[[bytes], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, rejected) of all files below folder."""
    ship(spark)
    found = files(spark, folder)
    every = markdown_blocks(found).unionByName(other_blocks(found, ocr))
    return every.filter("block_type <> 'error'"), every.filter("block_type = 'error'")


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(contracts, queries) of a SQuAD-shaped file: data[].paragraphs[0].{context, qas[]}; the first answer is the gold one."""
    data = spark.read.option("multiLine", True).json(path).select(F.posexplode("data").alias("no", "d"))
    first = data.select("no", F.col("d.title").alias("title"), F.element_at("d.paragraphs", 1).alias("p"))
    contracts = first.select("no", "title", F.sha2("p.context", 256).alias("sha256"), F.length("p.context").alias("char_length"), F.col("p.context").alias("text"))
    q = first.select("no", F.explode("p.qas").alias("q"))
    answer = F.try_element_at("q.answers", F.lit(1))
    return contracts, q.select("no", F.col("q.id").alias("query_id"), F.col("q.question").alias("question"), (F.size("q.answers") == 0).alias("is_unanswerable"), answer["text"].alias("gold_evidence"), answer["answer_start"].alias("gold_start"), F.size("q.answers").alias("gold_count"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
