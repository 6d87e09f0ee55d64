"""Identity: canonical JSON hashes, author and section ids, line hashes, and name encodings."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import urllib.parse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, IntegerType, LongType, ShortType, StringType, StructField


def canonical_json(value: object) -> str:
    """Compact JSON with sorted keys and unescaped non-ASCII text."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def hash_value(value: object) -> str:
    """Hash of an object (its canonical JSON) or of a plain text (its UTF-8 bytes)."""
    if isinstance(value, dict):
        return hashlib.sha256(canonical_json(value).encode()).hexdigest()
    if isinstance(value, str):
        return hashlib.sha256(value.encode()).hexdigest()
    raise TypeError(f"cannot hash {type(value).__name__}; give a dict or a str")


def author_id(name: str, email: str) -> str:
    return hash_value({"email": email, "name": name})


def section_hash(path: str, authors: list[str], license: str, year: str, contributors: list[str] | None = None) -> str:
    """Author order counts."""
    return hash_value({"authors": list(authors), "contributors": list(contributors or []), "license": license, "path": path, "year": str(year)})


def line_hash(line: str, text_mode: str = "raw") -> str:
    """JSON objects by their canonical form; other lines as raw text, or quoted as JSON with text_mode='json'."""
    try:
        parsed = json.loads(line)
    except ValueError:
        return hash_value(line) if text_mode == "raw" else hashlib.sha256(canonical_json(line).encode()).hexdigest()
    if isinstance(parsed, dict) or text_mode == "json":
        return hashlib.sha256(canonical_json(parsed).encode()).hexdigest()
    return hash_value(line.strip())


# ---------------------------------------------------------------- the same over columns


def struct_hash(**fields: Column) -> Column:
    """Canonical hash of an object with these fields. Null fields would be left out by to_json: coalesce them first."""
    return F.sha2(F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)])), 256)


#: Types that Spark's JSON writer spells as canonical JSON does (but for rare control characters).
PLAIN_TYPES = (StringType, BooleanType, ByteType, ShortType, IntegerType, LongType)


def object_hash_column(fields: list[StructField]) -> Column:
    """Canonical hash of a row with these columns: nulls are null fields, keys are sorted on every level, numbers are
    spelled as canonical JSON has them, so that a row hashes as its own JSON line. Rows of plain types stay in the JVM;
    others, and texts with unusual control characters, are written again by an Arrow-batched function."""
    names = sorted(f.name for f in fields)
    written = F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), {"ignoreNullFields": "false"})

    @F.pandas_udf(StringType())
    def hashed(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: hash_value(json.loads(x)))

    if all(isinstance(f.dataType, PLAIN_TYPES) for f in fields):
        return F.when(F.contains(written, F.lit("\\u00")), hashed(written)).otherwise(F.sha2(written, 256))
    return hashed(written)


def author_id_column(name: Column, email: Column) -> Column:
    return struct_hash(email=F.coalesce(email, F.lit("")), name=F.coalesce(name, F.lit("")))


def section_hash_column(path: Column, authors: Column, license: Column, year: Column, contributors: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return struct_hash(
        authors=F.coalesce(authors, none),
        contributors=none if contributors is None else F.coalesce(contributors, none),
        license=F.coalesce(license, F.lit("")),
        path=F.coalesce(path, F.lit("")),
        year=F.coalesce(year.cast("string"), F.lit("")),
    )


def text_hash_column(text: Column) -> Column:
    return F.sha2(text, 256)


def line_hash_column(line: Column, text_mode: str = "raw") -> Column:
    """line_hash of arbitrary lines. JSON has to be parsed and written again exactly, which Spark's own writer does not
    do (numbers, control characters), so lines that look like JSON go through an Arrow-batched function."""

    @F.pandas_udf(StringType())
    def hashed(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: None if x is None else line_hash(x, text_mode))

    if text_mode != "raw":
        return hashed(line)
    looks = F.ltrim(line).startswith("{") | F.rtrim(line).rlike(r'^\s*(-?[0-9][0-9.eE+-]*|true|false|null|NaN|-?Infinity|\[.*\]|".*")\s*$')
    return F.when(line.isNull(), F.lit(None)).when(looks, hashed(line)).otherwise(F.sha2(line, 256))


# ---------------------------------------------------------------- names


def url_encode(text: str) -> str:
    return urllib.parse.quote(text, safe="")


def url_encode_column(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def safe_filename(title: str, longest: int = 200) -> str:
    """URL-safe base64 of a title without padding; long names are cut and told apart by a hash."""
    name = base64.urlsafe_b64encode(title.encode()).decode().rstrip("=")
    if len(name) <= longest:
        return name
    return f"{name[: longest - 17]}-{hashlib.sha256(title.encode()).hexdigest()[:16]}"


def safe_filename_column(title: Column, longest: int = 200) -> Column:
    name = F.rtrim(F.translate(F.base64(title.cast("binary")), "+/\r\n", "-_"), F.lit("="))
    return F.when(F.length(name) <= longest, name).otherwise(F.concat(F.substring(name, 1, longest - 17), F.lit("-"), F.substring(F.sha2(title, 256), 1, 16)))


def xml_escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def find_root(start: str, marker: str = "strandlog-version") -> str | None:
    """The nearest folder at or above start that holds a ledger."""
    at = os.path.abspath(start)
    while True:
        if os.path.exists(os.path.join(at, marker)):
            return at
        up = os.path.dirname(at)
        if up == at:
            return None
        at = up


def normalize_file(path: str, root: str) -> str:
    """A data file's name in the ledger: relative to its root where it lies inside, with forward slashes."""
    full = os.path.abspath(os.path.join(root, path))
    inside = os.path.relpath(full, os.path.abspath(root))
    return (path if inside.startswith("..") else inside).replace(os.sep, "/")
