"""Queries over the provenance layers: authors, sections, documents. Pure functions from DataFrames to DataFrames.

Semi-joins run over the exploded sources of distinct lists, so that they are equi-joins whatever the lists' lengths, and
reach the records by the list itself, so that repeated records stay as they are. Sides are never forced to be broadcast:
adaptive execution picks that by their measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.errors import AuthorNotFound


def is_revoked(column: str = "revoked") -> Column:
    return F.coalesce(F.col(column), F.lit(False))


def query_authors(authors: DataFrame, name: str | None = None, email: str | None = None, author_id: str | None = None) -> DataFrame:
    """Exact matches of all that is given; everything if nothing is."""
    for column, value in (("name", name), ("email", email), ("id", author_id)):
        if value is not None:
            authors = authors.where(F.col(column) == value)
    return authors


def query_sections(sections: DataFrame, path: str | None = None, license: str | None = None, author_id: str | None = None, prefix: str | None = None, section_hash: str | None = None) -> DataFrame:
    if section_hash is not None:
        sections = sections.where(F.col("section_hash") == section_hash)
    if path is not None:
        sections = sections.where(F.col("path") == path)
    if prefix is not None:
        sections = sections.where(F.col("path").startswith(prefix))
    if license is not None:
        sections = sections.where(F.col("license") == license)
    if author_id is not None:
        sections = sections.where(F.coalesce(F.array_contains("authors", author_id), F.lit(False)))
    return sections


def resolve_authors(authors: DataFrame, refs: DataFrame, strict: bool = False) -> DataFrame:
    """refs: (ref). Rows (ref, id, matched_by): by id, then name, then email; the smallest id of equals. With strict,
    a reference without a match raises (the first five are named); else its id is null."""
    kinds = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), F.col(k).alias("ref")) for i, k in enumerate(("id", "name", "email"))])
    known = authors.select("id", F.explode(kinds).alias("k")).select("id", "k.rank", "k.kind", "k.ref")
    best = refs.select("ref").distinct().join(known, "ref", "left").groupBy("ref").agg(F.min(F.struct("rank", "id", "kind")).alias("m"))
    found = best.select("ref", F.col("m.id").alias("id"), F.when(F.col("m.id").isNotNull(), F.col("m.kind")).alias("matched_by"))
    if strict:
        missing = [r["ref"] for r in found.where("id is null").orderBy("ref").limit(6).collect()]
        if missing:
            raise AuthorNotFound("no author for " + ", ".join(missing[:5]) + (", ..." if len(missing) > 5 else ""))
    return found


def section_authors(sections: DataFrame) -> DataFrame:
    """Edges (section_hash, author_id)."""
    return sections.select("section_hash", F.explode("authors").alias("author_id"))


def sections_of_authors(sections: DataFrame, authors: DataFrame) -> DataFrame:
    """Hashes of sections with any of the authors (id)."""
    return section_authors(sections).join(authors.select(F.col("id").alias("author_id")), "author_id", "left_semi").select("section_hash").distinct()


def with_row_id(records: DataFrame) -> DataFrame:
    return records if "row_id" in records.columns else records.withColumn("row_id", F.monotonically_increasing_id())


def _touching(records: DataFrame, hashes: DataFrame) -> DataFrame:
    """The distinct lists of sources that hold any of the hashes (section_hash). Whether a record is touched depends on
    its list alone, and lists repeat: they are made distinct within each task before anything is shuffled, and the
    records need neither ids nor a shuffle as long as the touched lists are few."""
    kinds = records.select("sources").where(F.col("sources").isNotNull()).distinct()
    edges = kinds.select("sources", F.explode("sources").alias("section_hash"))
    return edges.join(hashes.select("section_hash").distinct(), "section_hash", "left_semi").select("sources").distinct()


def records_of_sections(records: DataFrame, hashes: DataFrame) -> DataFrame:
    """Records with any source among the hashes, each stored record once. A handful of hashes known beforehand is
    better served by records_of_section: one scan, no join."""
    return records.join(_touching(records, hashes), "sources", "left_semi")


def records_of_section(records: DataFrame, *hashes: str) -> DataFrame:
    return records.where(F.coalesce(F.arrays_overlap("sources", F.array(*map(F.lit, hashes))), F.lit(False)))


def revoked_sections(sections: DataFrame, authors: DataFrame) -> DataFrame:
    """Hashes of sections that are revoked themselves or have a revoked author."""
    own = sections.where(is_revoked()).select("section_hash")
    return own.unionByName(sections_of_authors(sections, authors.where(is_revoked()))).distinct()


def revoked_records(records: DataFrame, sections: DataFrame, authors: DataFrame, line_level: bool = True) -> DataFrame:
    """Records with a revoked source, or revoked themselves."""
    touched = _touching(records, revoked_sections(sections, authors))
    if not line_level:
        return records.join(touched, "sources", "left_semi")
    marked = records.join(touched.withColumn("__touched", F.lit(True)), "sources", "left")
    return marked.where(F.col("__touched") | is_revoked()).select(*records.columns)


def active_records(records: DataFrame, sections: DataFrame, authors: DataFrame, line_level: bool = True) -> DataFrame:
    """Records without any revoked source, and not revoked themselves unless line_level is off."""
    kept = records.where(~is_revoked()) if line_level else records
    return kept.join(_touching(kept, revoked_sections(sections, authors)), "sources", "left_anti")


def show(
    records: DataFrame,
    sections: DataFrame,
    authors: DataFrame,
    section: str | None = None,
    license: str | None = None,
    author: str | None = None,
    email: str | None = None,
    revoked: bool = False,
    line_level: bool = True,
) -> DataFrame:
    """Document records by section, else licence, else author (name, or email), else all; active ones by default."""
    found = records
    if section is not None:
        found = records_of_section(found, section)
    elif license is not None:
        found = records_of_sections(found, query_sections(sections, license=license))
    elif author is not None or email is not None:
        found = records_of_sections(found, sections_of_authors(sections, query_authors(authors, name=author, email=email)))
    pick = revoked_records if revoked else active_records
    return pick(found, sections, authors, line_level)


def lookup_record(records: DataFrame, line_hash: str, file: str | None = None, sources: list[str] | None = None) -> DataFrame:
    found = records.where(F.col("line_hash") == line_hash)
    if file is not None:
        found = found.where(F.col("file") == file)
    if sources is not None:
        found = found.where(F.array_sort("sources") == F.array(*map(F.lit, sorted(sources))))
    return found


def blame(lines: DataFrame, records: DataFrame, line_no: int | None = None) -> DataFrame:
    """lines: (line_no, line_hash) of a data file. The records of a line's content, in whatever file they were made."""
    wanted = lines if line_no is None else lines.where(F.col("line_no") == line_no)
    return wanted.join(records, "line_hash")


def latest_embeddings(embeddings: DataFrame, model: str | None = None) -> DataFrame:
    """One embedding for each line hash: the one written last."""
    found = embeddings if model is None else embeddings.where(F.col("model") == model)
    found = found.where("line_hash is not null and embedding is not null")
    return found.groupBy("line_hash").agg(F.max_by("embedding", "seq").alias("embedding"))


def lookup_embedding(embeddings: DataFrame, line_hash: str, model: str) -> DataFrame:
    """The last embedding of one line by one model; no row if there is none."""
    return latest_embeddings(embeddings.where(F.col("line_hash") == line_hash), model)


def embedding_counts(embeddings: DataFrame) -> DataFrame:
    """Rows (model, embeddings): lines that have one, each once."""
    return embeddings.where("line_hash is not null and embedding is not null").select("model", "line_hash").distinct().groupBy("model").agg(F.count("*").alias("embeddings"))


def query_log(log: DataFrame, op: str | None = None, since: str | None = None) -> DataFrame:
    """Newest first; times compare as strings."""
    if op is not None:
        log = log.where(F.col("op") == op)
    if since is not None:
        log = log.where(F.col("ts") >= since)
    return log.orderBy(F.col("seq").desc())


def layer_status(**layers: DataFrame) -> DataFrame:
    """Rows (layer, total, revoked)."""
    out = None
    for name, df in layers.items():
        revoked = F.count_if(is_revoked()) if "revoked" in df.columns else F.lit(0).cast("long")
        one = df.agg(F.count("*").alias("total"), revoked.alias("revoked")).select(F.lit(name).alias("layer"), "total", "revoked")
        out = one if out is None else out.unionByName(one)
    return out


def chain_sources(manifests: DataFrame) -> DataFrame:
    """manifests: (seq, sources). One row: all their sources, each at its first place."""
    flat = manifests.select("seq", F.posexplode("sources").alias("at", "source"))
    first = flat.groupBy("source").agg(F.min(F.struct("seq", "at")).alias("place"))
    return first.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "source"))), lambda x: x["source"]).alias("sources"))


def routing_index(authors: DataFrame, sections: DataFrame, records: DataFrame) -> DataFrame:
    """Rows (id, kind, refs): two-digit buckets in which an author's sections and a section's records lie, sorted."""
    by_author = section_authors(sections).groupBy(F.col("author_id").alias("id")).agg(F.array_sort(F.collect_set(F.substring("section_hash", 1, 2))).alias("refs"))
    by_section = records.select(F.explode("sources").alias("id"), F.substring("line_hash", 1, 2).alias("b")).groupBy("id").agg(F.array_sort(F.collect_set("b")).alias("refs"))
    return by_author.select("id", F.lit("author").alias("kind"), "refs").unionByName(by_section.select("id", F.lit("section").alias("kind"), "refs"))


def lookup_refs(index: DataFrame, id: str) -> DataFrame:
    """Buckets (kind, refs) of an author or section; no row if the index does not have it."""
    return index.where(F.col("id") == id).select("kind", "refs")


def index_stats(index: DataFrame) -> DataFrame:
    return index.agg(F.count_if(F.col("kind") == "author").alias("authors"), F.count_if(F.col("kind") == "section").alias("sections"))


def copyright_blocks(records: DataFrame, sections: DataFrame, authors: DataFrame, files: list[str] | None = None, per_author: bool = False, skip_revoked: bool = True) -> DataFrame:
    """Rows (file, line_hash, section_hash, license, block): one block for each record and source with its authors'
    lines, or one for each author with per_author (then an empty licence stays empty)."""
    if skip_revoked:
        records, sections, authors = (df.where(~is_revoked()) for df in (records, sections, authors))
    if files:
        records = records.where(F.col("file").isin(files))
    marked = with_row_id(records.where("line_hash <> '' and file <> ''"))
    used = marked.select("row_id", "file", "line_hash", F.posexplode("sources").alias("at", "section_hash"))
    known = sections.select("section_hash", "license", "year", F.posexplode("authors").alias("place", "author_id"))
    people = authors.groupBy("id").agg(F.min("name").alias("name"), F.min("email").alias("email"))
    year = F.when(F.coalesce("year", F.lit("")) != "", F.concat("year", F.lit(" "))).otherwise(F.lit(""))
    line = F.concat(F.lit("Copyright: "), year, "name", F.lit(" <"), "email", F.lit(">"))
    lined = known.join(people, F.col("author_id") == F.col("id")).withColumn("line", line)
    keys = ["row_id", "file", "line_hash", "at", "section_hash"]
    license = F.coalesce("license", F.lit("")) if per_author else F.when(F.coalesce("license", F.lit("")) == "", "UNKNOWN").otherwise(F.col("license"))
    joined = used.join(lined, "section_hash").withColumn("license", license)
    if not per_author:
        gathered = joined.groupBy(*keys, "license").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
        joined = gathered.withColumn("line", F.concat_ws("\n", F.transform("lines", lambda x: x["line"])))
    block = F.concat(F.lit("Files: "), "file", F.lit(":"), "line_hash", F.lit("\n"), "line", F.lit("\nLicense: "), "license", F.lit("\n"))
    return joined.select("file", "line_hash", "section_hash", "license", block.alias("block"))


def write_copyright(blocks: DataFrame, path: str) -> None:
    """The blocks in order, streamed to one file on the driver."""
    import os

    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        for i, row in enumerate(blocks.orderBy("file", "line_hash", "section_hash", "block").select("block").toLocalIterator()):
            out.write(("\n" if i else "") + row["block"])


def first_email_name(authors: DataFrame, email: str) -> DataFrame:
    return authors.where(F.col("email") == email).orderBy("id").limit(1).select("name")


def last_records(records: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key."""
    newest = Window.partitionBy(key).orderBy(F.col(order).desc())
    return records.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")
