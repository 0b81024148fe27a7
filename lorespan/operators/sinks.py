"""Sinks: bulk and batched writes, answer messages, ranges of stored bytes, packed exports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, *by: str, mode: str = "errorifexists") -> None:
    """Parquet by partition columns; rows of one partition meet in few files, and AQE splits skewed ones."""
    (df.hint("rebalance", *by) if by else df).write.mode(mode).partitionBy(*by).parquet(path)


def embed_batches(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], size: int = 10) -> DataFrame:
    """Texts with vectors of a model that is called with lists of at most `size`; null texts have null vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list = [None] * len(f)
            at = [i for i, t in enumerate(f["text"]) if t is not None]
            for k in range(0, len(at), size):
                part = at[k : k + size]
                for i, v in zip(part, model([f["text"].iat[i] for i in part]), strict=True):
                    out[i] = v
            f["embedding"] = out
            yield f

    fields = ", ".join(f"`{n}` {t}" for n, t in texts.dtypes)
    return texts.mapInPandas(run, f"{fields}, embedding array<float>")


def stream_message(chat_id: Column, record_id: Column, content: Column, is_end: Column) -> Column:
    """One server-sent event."""
    body = F.to_json(F.struct(chat_id.alias("chat_id"), record_id.alias("chat_record_id"), F.lit(True).alias("operate"), content.alias("content"), is_end.alias("is_end")))
    return F.concat(F.lit("data: "), body, F.lit("\n\n"))


def completion_message(record_id: Column, content: Column, prompt_tokens: Column, answer_tokens: Column) -> Column:
    """A chat completion in the widespread JSON shape."""
    message = F.struct(F.lit("assistant").alias("role"), content.alias("content"))
    choices = F.array(F.struct(F.lit(0).alias("index"), message.alias("message"), F.lit("stop").alias("finish_reason")))
    usage = F.struct(prompt_tokens.alias("prompt_tokens"), answer_tokens.alias("completion_tokens"), (prompt_tokens + answer_tokens).alias("total_tokens"))
    return F.to_json(F.struct(record_id.alias("id"), F.lit("chat.completion").alias("object"), choices.alias("choices"), usage.alias("usage")))


def byte_range(content: Column, start: int, end: int | None = None) -> Column:
    """Bytes from start to end (inclusive, from 0), to the end of the content if there's none."""
    return F.substring(content, F.lit(start + 1), F.length(content) if end is None else F.lit(end - start + 1))


def pack_archive(rows: Iterator[tuple[str, bytes]]) -> bytes:
    """A ZIP of named contents, for one document's export."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in rows:
            z.writestr(name, content)
    return out.getvalue()


def packed_exports(files: DataFrame) -> DataFrame:
    """One archive per document (document_id, name, content): a document's files are few, its own upload."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("name", kind="stable")
        return pd.DataFrame({"document_id": [f["document_id"].iloc[0]], "archive": [pack_archive(zip(f["name"], map(bytes, f["content"]), strict=True))]})

    return files.groupBy("document_id").applyInPandas(run, "document_id string, archive binary")


#: Characters that XML can't hold.
_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_SHEET_XML = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE_XML = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE_XML = "http://schemas.openxmlformats.org/package/2006/relationships"


def _xml(text: str) -> str:
    return escape(_NOT_XML.sub("", text), {"\r": "&#13;", '"': "&quot;"})


def workbook(sheets: list[tuple[str, list[list[str | None]]]]) -> bytes:
    """An XLSX file of sheets by name, all cells as text."""
    parts = {"[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{n + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for n in range(len(sheets))) + "</Types>"}
    parts["_rels/.rels"] = f'<Relationships xmlns="{_PACKAGE_XML}"><Relationship Id="r1" Type="{_OFFICE_XML}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    parts["xl/workbook.xml"] = f'<workbook xmlns="{_SHEET_XML}" xmlns:r="{_OFFICE_XML}"><sheets>' + "".join(f'<sheet name="{_xml(name)}" sheetId="{n + 1}" r:id="r{n + 1}"/>' for n, (name, _) in enumerate(sheets)) + "</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{_PACKAGE_XML}">' + "".join(f'<Relationship Id="r{n + 1}" Type="{_OFFICE_XML}/worksheet" Target="worksheets/sheet{n + 1}.xml"/>' for n in range(len(sheets))) + "</Relationships>"
    for n, (_, rows) in enumerate(sheets):
        cell = lambda i, j, v: f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t xml:space="preserve">{_xml(v)}</t></is></c>' if v is not None else ""
        body = "".join(f'<row r="{i + 1}">' + "".join(cell(i, j, v) for j, v in enumerate(row)) + "</row>" for i, row in enumerate(rows))
        parts[f"xl/worksheets/sheet{n + 1}.xml"] = f'<worksheet xmlns="{_SHEET_XML}"><sheetData>{body}</sheetData></worksheet>'
    return pack_archive((name, b'<?xml version="1.0" encoding="UTF-8"?>' + text.encode("utf-8", "replace")) for name, text in parts.items())


def workbooks(rows: DataFrame, key: str, header: list[str]) -> DataFrame:
    """key, workbook: one XLSX file for each key (a document or knowledge base, whose sheets are its own) of rows (key, sheet,
    place, and a text column for each heading), sheets by name, rows by place."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        sheets = [(name, [header, *([v if isinstance(v, str) else None for v in r] for r in g.sort_values("place", kind="stable")[header].itertuples(index=False))]) for name, g in f.groupby("sheet", sort=True)]
        return pd.DataFrame({key: [f[key].iloc[0]], "workbook": [workbook(sheets)]})

    return rows.select(key, "sheet", "place", *header).groupBy(key).applyInPandas(run, f"{key} string, workbook binary")


def compressed(content: Column | str) -> Column:
    """Contents as they are stored: a ZIP of one member; null stays null."""

    @F.pandas_udf("binary")
    def run(c: pd.Series) -> pd.Series:
        return c.map(lambda x: pack_archive([("content", bytes(x))]) if x is not None else None)

    return run(content)


def uncompressed(stored: Column | str) -> Column:
    """The content of a stored file; what is no ZIP of that kind is the content itself."""

    def one(raw: bytes | None) -> bytes | None:
        if raw is None:
            return None
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                return z.read("content")
        except (zipfile.BadZipFile, KeyError):
            return bytes(raw)

    @F.pandas_udf("binary")
    def run(c: pd.Series) -> pd.Series:
        return c.map(one)

    return run(stored)
