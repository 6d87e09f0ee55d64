"""The ledger: versioned Parquet tables in a folder, staged batches, and the operations of the public API.

A table is a folder of parts that never change (``<table>/v=N``) and a manifest that lists the current ones. A part is
written aside and the manifest replaced in one step, so that readers resolve a version once and never see half a write.
An append writes its own rows only; parts of like size are merged once there are ``FAN`` of them, so that a row is
rewritten as often as the table grows by that factor. Staged rows go to ``staging/<table>/<batch>`` and become part of
the table by ``compact``, whose manifest also names the batches it took: a batch that comes again is left out. One
writer at a time is assumed, any number of readers. All logic is in the operators; this class only loads and saves.
"""

from __future__ import annotations

import contextlib
import datetime
import json
import os
import re
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from strandlog import __version__, schemas
from strandlog.errors import AlreadyInitialized, InvalidRecord, NotFound, NotInitialized, NotRevoked, SectionNotFound, SourceStackError, StagedData
from strandlog.functions import hashing
from strandlog.operators import merge, provenance, reconcile, revocation, tokens
from strandlog.sources import files
from strandlog.sources import lines as line_source

MARKER = "strandlog-version"
#: Parts of like size that a table has before they are merged.
FAN = 16
#: Batches of a stream: its name and a number that grows.
NUMBERED = re.compile(r"(.+)-(\d{12})")


class SourceStack(threading.local):
    """Active sources of the current thread: (file, section hashes)."""

    def __init__(self) -> None:
        self.items: list[tuple[str, tuple[str, ...]]] = []

    def push(self, file: str, hashes: list[str]) -> None:
        self.items.append((file, tuple(hashes)))

    def pop(self, file: str | None = None) -> tuple[str, tuple[str, ...]]:
        if not self.items:
            raise SourceStackError("no active source")
        if file is None:
            return self.items.pop()
        for i, item in enumerate(self.items):
            if item[0] == file:
                return self.items.pop(i)
        raise SourceStackError(f"{file} is not an active source")

    def active(self) -> list[str]:
        return sorted({h for _, hashes in self.items for h in hashes})


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        if not files.exists(spark, os.path.join(path, MARKER)):
            raise NotInitialized(path)
        self.stack = SourceStack()

    @classmethod
    def init(cls, spark: SparkSession, path: str, force: bool = False) -> Ledger:
        """Create a ledger. With force an existing one is kept as it is (its log too)."""
        marker = os.path.join(path, MARKER)
        if files.exists(spark, marker) and not force:
            raise AlreadyInitialized(path)
        files.make_folder(spark, path)
        files.write_text(spark, marker, __version__)
        return cls(spark, path)

    # ------------------------------------------------------------ storage

    def _manifest(self, name: str) -> dict:
        """parts: [folder, bytes] of each; batches, streams and last: what compact took (see _taken)."""
        text = files.read_text(self.spark, os.path.join(self.path, name, "current"))
        found = {"parts": [], "batches": [], "streams": {}, "last": []}
        if text is None:
            return found
        return found | (json.loads(text) if text.startswith("{") else {"parts": [[text.strip(), 0]]})

    def _publish(self, name: str, manifest: dict, old: dict) -> None:
        """Make a manifest the current one. Parts that neither it nor the one before lists have had no new readers for a
        whole version and go."""
        files.write_text(self.spark, os.path.join(self.path, name, "current"), json.dumps(manifest))
        kept = {p for m in (manifest, old) for p, _ in m["parts"]}
        gone = {p for p, _ in old.get("before", [])} - kept
        for part in gone:
            files.delete(self.spark, os.path.join(self.path, name, part))

    def _read(self, name: str, parts: list) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schemas.TABLES[name])
        return self.spark.read.schema(schemas.TABLES[name]).parquet(*[os.path.join(self.path, name, p) for p, _ in parts])

    def table(self, name: str) -> DataFrame:
        return self._read(name, self._manifest(name)["parts"])

    def _write(self, name: str, df: DataFrame) -> list:
        """The [folder, bytes] of a new part, none if it has no row."""
        schema = schemas.TABLES[name]
        part = f"v={uuid.uuid4().hex}"
        where = os.path.join(self.path, name, part)
        columns = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType) for f in schema.fields]
        df.select(*[c.alias(f.name) for c, f in zip(columns, schema.fields, strict=True)]).write.parquet(where)
        if not self.spark.read.schema(schema).parquet(where).head(1):
            files.delete(self.spark, where)
            return []
        return [[part, files.size(self.spark, where)]]

    def replace(self, name: str, df: DataFrame) -> None:
        old = self._manifest(name)
        self._publish(name, old | {"parts": self._write(name, df), "before": old["parts"]}, old)

    def append(self, name: str, df: DataFrame, **taken: object) -> list:
        """Add the rows of df as a part of their own; taken: what else the manifest records. Returns the new part."""
        old = self._manifest(name)
        new = self._write(name, df)
        if new or taken:
            self._publish(name, old | {"parts": old["parts"] + new, "before": old["parts"]} | taken, old)
            self._merge_parts(name)
        return new

    def _merge_parts(self, name: str) -> None:
        """Write FAN or more parts of like size as one. Their order has no meaning: rows carry seq or pos."""
        old = self._manifest(name)
        levels: dict[int, list] = {}
        for part in old["parts"]:
            levels.setdefault(max(0, part[1].bit_length() - 1) // 4, []).append(part)
        many = next((parts for _, parts in sorted(levels.items()) if len(parts) >= FAN), None)
        if many:
            rest = [p for p in old["parts"] if p not in many]
            n = max(1, sum(size for _, size in many) >> 27)
            self._publish(name, old | {"parts": rest + self._write(name, self._read(name, many).coalesce(n)), "before": old["parts"]}, old)

    def _taken(self, name: str, batch: str) -> bool:
        """Whether compact has merged this batch: one of a stream up to the greatest number taken (a stream's batches
        come in order), another one by its name."""
        m = self._manifest(name)
        numbered = NUMBERED.fullmatch(batch)
        if numbered:
            return int(numbered[2]) <= m["streams"].get(numbered[1], -1)
        return batch in m["batches"] or batch in m["last"]

    def stage(self, name: str, df: DataFrame, batch: str | None = None) -> None:
        """Write a batch aside; a batch of a name that is there already, or was merged before, is left as it is."""
        target = os.path.join(self.path, "staging", name, batch or f"once={uuid.uuid4().hex}")
        if (batch and self._taken(name, batch)) or files.exists(self.spark, os.path.join(target, "_SUCCESS")):
            return
        df.write.mode("overwrite").parquet(target)

    def staged(self, name: str | None = None) -> list[str]:
        """Folders of batches that wait; one that was merged but not deleted yet does not."""
        root = os.path.join(self.path, "staging")
        layers = [name] if name else files.names(self.spark, root)
        return [os.path.join(root, n, b) for n in layers for b in files.names(self.spark, os.path.join(root, n)) if not self._taken(n, b)]

    def check_compact(self) -> None:
        if self.staged():
            raise StagedData("staged batches wait; compact first")

    def compact(self, rotate_at: int = 10 << 20) -> dict[str, int]:
        """Merge staged batches into the tables, archive revoked and orphan records, rotate a large log. Token entries
        get positions after the last one; none is ever removed. Rows and the names of their batches are published
        together, so that after a failure at any place the next call goes on where this one stopped."""
        merged = {}
        root = os.path.join(self.path, "staging")
        for name in ("documents", "embeddings", "tokens"):
            batches = self.staged(name)
            if batches:
                added = self.spark.read.schema(schemas.TABLES[name]).parquet(*batches)
                if name == "tokens":
                    added = self._positioned(added)
                if name == "embeddings":
                    start = (self.table(name).agg(F.max("seq")).first()[0] or 0) + 1
                    added = added.withColumn("seq", F.lit(start).cast("long"))
                self.append(name, added, **self._taking(name, [os.path.basename(b) for b in batches]))
                merged[name] = len(batches)
            for b in files.names(self.spark, os.path.join(root, name)):
                if self._taken(name, b):
                    files.delete(self.spark, os.path.join(root, name, b))
            files.delete(self.spark, os.path.join(self.path, "aside", name))
        self.archive_revoked()
        self.rotate_log(rotate_at)
        return merged

    def _taking(self, name: str, batches: list[str]) -> dict:
        m = self._manifest(name)
        streams = dict(m["streams"])
        for found in filter(None, map(NUMBERED.fullmatch, batches)):
            streams[found[1]] = max(int(found[2]), streams.get(found[1], -1))
        named = [b for b in batches if not NUMBERED.fullmatch(b) and not b.startswith("once=")]
        return {"streams": streams, "batches": sorted({*m["batches"], *named}), "last": [b for b in batches if b.startswith("once=")]}

    def _positioned(self, added: DataFrame) -> DataFrame:
        """Token entries with positions and file numbers after the last ones of their tokenizer."""
        last = self.table("tokens").groupBy("tokenizer").agg((F.max("pos") + 1).alias("p"), (F.max("file_number") + 1).alias("f"))
        ends = {r["tokenizer"]: (r["p"], r["f"]) for r in added.select("tokenizer").distinct().join(last, "tokenizer", "left").collect()}
        parts = None
        for i, (t, (pos, number)) in enumerate(ends.items()):
            own = added.where(F.col("tokenizer").eqNullSafe(F.lit(t))).drop("pos").withColumn("file_number", F.lit(number or 0))
            one = tokens.number_appended(own, pos or 0, ["token_count"], self._aside("tokens", str(i)))
            parts = one if parts is None else parts.unionByName(one)
        return parts

    def _aside(self, name: str, kind: str) -> str:
        return os.path.join(self.path, "aside", name, kind)

    # ------------------------------------------------------------ log and archive

    def log(self, op: str, cmd: str = "", **detail: object) -> None:
        seq = (self.table("log").agg(F.max("seq")).first()[0] or 0) + 1
        now = datetime.datetime.now(datetime.timezone.utc).isoformat()
        self.append("log", self.spark.createDataFrame([(seq, now, op, {k: str(v) for k, v in detail.items()}, cmd)], schemas.LOG))

    def query_log(self, op: str | None = None, since: str | None = None) -> DataFrame:
        return provenance.query_log(self.table("log"), op, since)

    def rotate_log(self, most_bytes: int = 10 << 20) -> int:
        """Move a log of at least this size to the archive folder; returns its lines."""
        log = self.table("log")
        size = log.agg(F.sum(F.octet_length(F.to_json(F.struct(*log.columns))) + 1)).first()[0] or 0
        if size < most_bytes:
            return 0
        n = log.count()
        log.write.json(os.path.join(self.path, "archive-log", datetime.datetime.now(datetime.timezone.utc).strftime("log.%Y%m%dT%H%M%S%f")))
        self.replace("log", self.spark.createDataFrame([], schemas.LOG))
        return n

    def archive_revoked(self) -> None:
        """Copies of revoked authors and sections and of revoked or orphan records, each once."""
        now = F.date_format(F.current_timestamp(), "yyyyMMdd'T'HHmmss")
        copies = None
        for layer, key in (("authors", "id"), ("sections", "section_hash"), ("documents", "line_hash")):
            df = self.current(layer)
            bad = provenance.is_revoked() | (F.coalesce("orphan", F.lit(False)) if layer == "documents" else F.lit(False))
            one = df.where(bad).select(F.lit(layer).alias("layer"), F.col(key).alias("key"), F.to_json(F.struct(*df.columns)).alias("record"), now.alias("archived_at"), F.lit(0).cast("long").alias("batch_id"))
            copies = one if copies is None else copies.unionByName(one)
        self.append("archive", copies.dropDuplicates(["layer", "key", "record"]).join(self.table("archive").select("layer", "key", "record"), ["layer", "key", "record"], "left_anti"))

    # ------------------------------------------------------------ writing

    def current(self, layer: str) -> DataFrame:
        """A layer with effective revocation flags."""
        level = {"authors": "author", "sections": "section", "documents": "line", "tokens": "token"}[layer]
        return revocation.effective_flags(self.table(layer), self.table("events"), level)

    def add_author(self, name: str, email: str) -> str:
        if not name or not email:
            raise InvalidRecord("an author needs a name and an e-mail address")
        id = hashing.author_id(name, email)
        new = self.spark.createDataFrame([(id, name, email, False)], schemas.AUTHORS)
        self.replace("authors", merge.absorb(self.table("authors"), new, "authors"))
        self.log("author.add", id=id)
        return id

    def register_section(self, path: str, authors: list[str], license: str, year: str, contributors: list[str] | None = None, chain: list[str] | None = None) -> str:
        """authors, contributors: ids, names or e-mail addresses. chain: manifests (JSON files with sources)."""
        refs = self.spark.createDataFrame([(r,) for r in [*authors, *(contributors or [])]], "ref string")
        ids = {r["ref"]: r["id"] for r in provenance.resolve_authors(self.table("authors"), refs, strict=True).collect()}
        own, others = [ids[a] for a in authors], [ids[c] for c in contributors or []]
        h = hashing.section_hash(path, own, license, year, others)
        sources = None
        if chain:
            found = None
            for i, p in enumerate(chain):
                one = self.spark.read.schema("sources array<string>").json(p).select(F.lit(i).alias("seq"), "sources")
                found = one if found is None else found.unionByName(one)
            sources = provenance.chain_sources(found).first()["sources"]
        new = self.spark.createDataFrame([(h, path, own, others, license, str(year), False, sources)], schemas.SECTIONS)
        self.replace("sections", merge.absorb(self.table("sections"), new, "sections"))
        self.log("register.add", section=h)
        return h

    def track(self, df: DataFrame, file: str, sources: list[str] | None = None, text_column: str | None = None, token_count: str | None = None, tokenizer: str | None = None, embedding: str | None = None, model: str | None = None, batch: str | None = None) -> DataFrame:
        """Stage the records of a DataFrame: of one text column, or of its rows as objects. Sources default to the
        stack's. A record of the same hash, file and sources is staged once. Returns (line_hash, written)."""
        hashes = sorted(sources) if sources is not None else self.stack.active()
        if not hashes:
            raise SourceStackError("no sources: give some or open a source")
        if (embedding is None) != (model is None):
            raise InvalidRecord("an embedding and its model go together")
        file = hashing.normalize_file(file, self.path)
        fields = [c for c in df.columns if c not in (token_count, embedding)]
        h = hashing.text_hash_column(F.col(text_column)) if text_column else hashing.object_hash_column([df.schema[c] for c in fields])
        marked = df.withColumn("line_hash", h)
        key = F.array(*map(F.lit, hashes))
        fresh = marked.select("line_hash").distinct()
        known = self.table("documents")
        for b in self.staged("documents"):
            known = known.unionByName(self.spark.read.schema(schemas.DOCUMENTS).parquet(b))
        known = known.where((F.col("file") == file) & (F.array_sort("sources") == key)).select("line_hash").distinct()
        new = fresh.join(known, "line_hash", "left_anti")
        rows = new.select("line_hash", F.lit(file).alias("file"), key.alias("sources"), F.lit("track").alias("source_type"), F.lit(False).alias("revoked"), F.lit(False).alias("orphan"))
        self.stage("documents", rows, batch)
        if token_count is not None and tokenizer is not None:
            entries = marked.select(F.lit(None).cast("long").alias("pos"), F.lit(0).alias("file_number"), F.col(token_count).cast("long").alias("token_count"), key.alias("sources"), F.lit(tokenizer).alias("tokenizer"), F.lit(False).alias("revoked"))
            self.stage("tokens", entries, batch)
        if embedding is not None:
            self.stage("embeddings", marked.select("line_hash", F.col(embedding).cast("array<double>").alias("embedding"), F.lit(model).alias("model"), F.lit(0).cast("long").alias("seq")), batch)
        return fresh.join(known.withColumn("known", F.lit(True)), "line_hash", "left").select("line_hash", F.col("known").isNull().alias("written"))  # as of the batches staged before

    @contextlib.contextmanager
    def source(self, file: str, section: str | None = None) -> Iterator[list[str]]:
        """Sections of a file (or one of them) are the sources of what is tracked inside."""
        found = provenance.query_sections(self.current("sections"), path=file, section_hash=section).where(~provenance.is_revoked())
        hashes = sorted(r["section_hash"] for r in found.select("section_hash").distinct().collect())
        if not hashes:
            raise SectionNotFound(file)
        self.stack.push(file, hashes)
        try:
            yield hashes
        finally:
            self.stack.pop(file)

    # ------------------------------------------------------------ reading

    def show(self, **options: object) -> DataFrame:
        return provenance.show(self.current("documents"), self.current("sections"), self.current("authors"), **options)

    def blame(self, file: str, line_no: int) -> DataFrame:
        return provenance.blame(line_source.numbered_lines(self.spark, file), self.current("documents"), line_no)

    def status(self) -> DataFrame:
        return provenance.layer_status(**{n: self.current(n) for n in ("authors", "sections", "documents", "tokens")}, log=self.table("log"), embeddings=self.table("embeddings"))

    def embedding_counts(self) -> DataFrame:
        """Rows (model, embeddings)."""
        return provenance.embedding_counts(self.table("embeddings"))

    def embedding(self, line_hash: str, model: str) -> list[float]:
        """The last embedding of a line; staged ones have to be merged first."""
        if self.staged("embeddings"):
            raise StagedData("staged embeddings wait; compact first")
        found = provenance.lookup_embedding(self.table("embeddings"), line_hash, model).first()
        if found is None:
            raise NotFound(f"{model} has no embedding of {line_hash}")
        return list(found["embedding"])

    def token_entry(self, tokenizer: str, pos: int) -> Row:
        """The token entry at a position; NotFound beyond the last one."""
        found = tokens.entry_at(self.current("tokens"), tokenizer, pos).first()
        if found is None:
            raise NotFound(f"{tokenizer} has no entry {pos}")
        return found

    def export_copyright(self, path: str | None = None, **options: object) -> DataFrame:
        self.check_compact()
        blocks = provenance.copyright_blocks(self.current("documents"), self.current("sections"), self.current("authors"), **options)
        if path:
            provenance.write_copyright(blocks, path)
        return blocks

    def token_show(self, tokenizer: str, section: str | None = None, author: str | None = None, revoked: bool = False) -> DataFrame:
        sections = self.current("sections")
        if section is not None:
            hashes = sections.where(F.col("section_hash") == section)
        else:
            hashes = provenance.sections_of_authors(sections, provenance.query_authors(self.current("authors"), name=author))
        return tokens.token_show(self.current("tokens"), hashes, tokenizer, revoked)

    def removal_set(self, tokenizer: str, path: str | None = None) -> DataFrame:
        found = tokens.removal_bytes(self.current("tokens"), tokenizer)
        if path:
            tokens.write_removal_set(found, path)
        return found

    # ------------------------------------------------------------ revocation and purging

    def _record(self, changed: DataFrame, op: str, detail: dict) -> int:
        start = (self.table("events").agg(F.max("seq")).first()[0] or 0) + 1
        before = self.table("events").count()
        self.append("events", changed.withColumn("seq", F.lit(start).cast("long")))
        n = self.table("events").count() - before
        self.log(op, **detail, changed=n)
        return n

    def revoke(self, author: str | None = None, email: str | None = None, section: str | None = None, path: str | None = None, line_hash: str | None = None, file: str | None = None, tokenizer: str | None = None, restore: bool = False, toggle: bool = False) -> int:
        """Revoke (or restore) a line of a file, a section, an author, or with tokenizer an author's token entries.
        Returns how many records change."""
        if line_hash is not None and (file is None or any(x is not None for x in (author, email, section, path, tokenizer))):
            raise InvalidRecord("a line hash goes with a file and with nothing else")
        if (section is not None or path is not None) and (author is not None or email is not None):
            raise InvalidRecord("name a section or an author, not both")
        action, op = ("restore", "revoke.reverse") if restore else ("revoke", "revoke")
        if line_hash is not None:
            level, hit = "line", provenance.lookup_record(self.current("documents"), line_hash, file)
        elif section is not None or path is not None:
            level, hit = "section", provenance.query_sections(self.current("sections"), section_hash=section, path=path)
        elif author is not None or email is not None:
            level, hit = "author", provenance.query_authors(self.current("authors"), name=author, email=email)
            if tokenizer is not None:
                level, hit = "token", tokens.entries_of_sections(self.current("tokens").where(F.col("tokenizer") == tokenizer), provenance.sections_of_authors(self.current("sections"), hit))
        else:
            raise InvalidRecord("nothing named to revoke")
        return self._record(revocation.changes(hit, level, action, toggle), op, {"level": level})

    def purge(self, file: str, out: str | None = None, author: str | None = None, dry_run: bool = False, scope: str = "all") -> dict[str, int]:
        """Write the kept lines of a file to out, in order, or without out put them in the file's own place; purged lines
        go to the archive first. With author, only that author's lines, and the author has to be revoked. A dry run
        counts and writes nothing."""
        records, sections, authors = (self.current(n) for n in ("documents", "sections", "authors"))
        if author is not None:
            who = provenance.query_authors(authors, name=author)
            if not who.where(provenance.is_revoked()).head(1):
                raise NotRevoked(author)
            hashes = provenance.records_of_sections(records, provenance.sections_of_authors(sections, who)).select("line_hash").distinct()
        else:
            hashes = revocation.purge_set(records, sections, authors, scope)
        kept, gone = revocation.purge_split(line_source.numbered_lines(self.spark, file), hashes)
        if dry_run:
            return {"purged": gone.count(), "kept": kept.count(), "archived": 0}
        batch = (self.table("archive").agg(F.max("batch_id")).first()[0] or 0) + 1
        stamp = F.date_format(F.current_timestamp(), "yyyyMMdd'T'HHmmss")
        record = F.to_json(F.struct("line_no", "line"))
        layer = f"purge:{hashing.normalize_file(file, self.path)}"
        part = self.append("archive", gone.select(F.lit(layer).alias("layer"), F.col("line_hash").alias("key"), record.alias("record"), stamp.alias("archived_at"), F.lit(batch).cast("long").alias("batch_id")))
        written = Observation()
        target = out or f"{file}.kept-{uuid.uuid4().hex}"
        kept.orderBy("line_no").observe(written, F.count("*").alias("kept")).select("line").write.mode("overwrite").text(target)
        if out is None and part:
            files.swap(self.spark, target, file)
        elif out is None:
            files.delete(self.spark, target)
        purged = self.table("archive").where((F.col("layer") == layer) & (F.col("batch_id") == batch)).count() if part else 0
        counts = {"kept": written.get["kept"], "purged": purged}
        self.log("purge", file=file, **counts)
        return counts | {"archived": purged}

    def purge_reverse(self, file: str, purged_out: str, out: str) -> int:
        """Append the newest purged batch of a file to its lines (at the end), and drop it from the archive."""
        layer = f"purge:{hashing.normalize_file(file, self.path)}"
        archive = self.table("archive")
        last = archive.where(F.col("layer") == layer).agg(F.max("batch_id")).first()[0]
        if last is None:
            return 0
        mine = (F.col("layer") == layer) & (F.col("batch_id") == last)
        back = archive.where(mine).select(F.from_json("record", "line_no long, line string").alias("r")).select(F.lit(1).alias("late"), "r.line_no", "r.line")
        stay = line_source.numbered_lines(self.spark, purged_out).select(F.lit(0).alias("late"), "line_no", "line")
        stay.unionByName(back).orderBy("late", "line_no").select("line").write.mode("overwrite").text(out)
        n = back.count()
        self.replace("archive", archive.where(~(mine & F.col("layer").isNotNull())))
        return n

    def drop_revoked_tokens(self, tokenizer: str) -> int:
        """Remove revoked entries for good and number the rest anew. This breaks positions: removal sets made before
        no longer fit."""
        own = self.current("tokens")
        gone = own.where((F.col("tokenizer") == tokenizer) & provenance.is_revoked())
        n = gone.count()
        rest = own.where((F.col("tokenizer") == tokenizer) & ~provenance.is_revoked())
        numbered = tokens.number_appended(rest.withColumnRenamed("pos", "old"), 0, ["old"], self._aside("tokens", "kept")).drop("old")
        self.replace("tokens", own.where(~F.col("tokenizer").eqNullSafe(F.lit(tokenizer))).unionByName(numbered))
        files.delete(self.spark, os.path.join(self.path, "aside", "tokens"))
        self.replace("events", self.table("events").where(~((F.col("level") == "token") & (F.col("tokenizer").eqNullSafe(F.lit(tokenizer))))))
        return n

    # ------------------------------------------------------------ whole-ledger operations

    def absorb(self, other: Ledger, dedupe_tokens: bool = True) -> dict[str, tuple[int, int]]:
        """Take in the records of another ledger: added and skipped by layer."""
        self.check_compact()
        counts = {}
        for layer in ("authors", "sections", "documents", "tokens"):
            source = other.current(layer)
            row = merge.absorb_counts(self.table(layer), source, layer, dedupe_tokens or layer != "tokens").first()
            counts[layer] = (row["added"], row["skipped"])
            if not row["added"]:
                continue
            new = merge.new_records(self.table(layer), source, layer, dedupe_tokens or layer != "tokens")
            if layer == "tokens":
                self.stage("tokens", new)
                self.compact()
            else:
                self.append(layer, new)
        self.log("merge.absorb", **{k: v[0] for k, v in counts.items()})
        return counts

    def build_index(self) -> DataFrame:
        """Write the routing index and the token index; counts of the first."""
        index = provenance.routing_index(self.table("authors"), self.table("sections"), self.table("documents"))
        path = os.path.join(self.path, "index")
        index.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(os.path.join(path, "routing"))
        tokens.write_source_index(self.table("tokens"), os.path.join(path, "tokens"))
        return provenance.index_stats(self.spark.read.parquet(os.path.join(path, "routing")))

    def lookup(self, id: str) -> DataFrame:
        """Buckets (kind, refs) of an author or section, from the index as it was built last."""
        return provenance.lookup_refs(self.spark.read.parquet(os.path.join(self.path, "index", "routing")), id)

    def source_positions(self, tokenizer: str, section: str) -> DataFrame:
        """Positions (pos) of a section's token entries, from the index as it was built last."""
        return tokens.lookup_source(self.spark.read.parquet(os.path.join(self.path, "index", "tokens")), tokenizer, section)

    def embed(self, file: str, encode: Callable[[list[str]], list[list[float]]], model: str) -> int:
        """Embed every line of a file that the model has no embedding of, each content once. Returns how many."""
        self.check_compact()
        rest = reconcile.lines_to_embed(line_source.numbered_lines(self.spark, file), self.table("embeddings"), model)
        n = self._store_embeddings(reconcile.encode_lines(rest, encode), model)
        self.log("embed", file=file, model=model, embedded=n)
        return n

    def _store_embeddings(self, coded: DataFrame, model: str) -> int:
        """Append the vectors of coded (line_hash, embedding, ...); they are computed once, by this write."""
        seq = (self.table("embeddings").agg(F.max("seq")).first()[0] or 0) + 1
        part = self.append("embeddings", coded.select("line_hash", "embedding", F.lit(model).alias("model"), F.lit(seq).cast("long").alias("seq")))
        return self.table("embeddings").where(F.col("seq") == seq).count() if part else 0

    def reconcile(self, file: str, encode: Callable[[list[str]], list[list[float]]] | None = None, threshold: float = 0.85, model: str | None = None) -> dict[str, int]:
        """Compare a file with its records; with an encoder, move provenance to edited lines. Counts by status. model:
        the encoder's; the vectors of new lines are stored under it, and only its old ones are compared (default: all
        old ones, and new vectors are stored without a model)."""
        self.check_compact()
        name = hashing.normalize_file(file, self.path)
        records = self.current("documents")
        data = line_source.numbered_lines(self.spark, file)
        states = reconcile.line_states(data, reconcile.manifest(records, name))
        counts = {"matched": 0, "new": 0, "duplicate": 0, "orphan": 0, "moved": 0} | {r["status"]: r["n"] for r in reconcile.state_counts(states).collect()}
        if encode is not None:
            old = provenance.latest_embeddings(self.table("embeddings"), model).join(states.where("status = 'orphan'").select("line_hash"), "line_hash", "left_semi")
            old = old.select(F.col("line_hash").alias("id"), F.xxhash64("line_hash").alias("seq"), "embedding")
            fresh = states.where("status = 'new'").join(data.select("line_no", "line"), "line_no").select("line_no", "line_hash", "line")
            own = self.table("embeddings").where(F.col("model").eqNullSafe(F.lit(model)))
            self._store_embeddings(reconcile.encode_lines(fresh.join(own.select("line_hash"), "line_hash", "left_anti"), encode), model)
            coded = fresh.join(provenance.latest_embeddings(self.table("embeddings").where(F.col("model").eqNullSafe(F.lit(model)))), "line_hash")
            moved = reconcile.match_moved(reconcile.nearest_old(coded.select(F.col("line_hash").alias("id"), F.col("line_no").alias("seq"), "embedding"), old), threshold)
            records, replaced = reconcile.move_provenance(records, moved, name)
            counts["moved"] = moved.count()
            stamp = F.date_format(F.current_timestamp(), "yyyyMMdd'T'HHmmss")
            self.append("archive", replaced.select(F.lit("documents").alias("layer"), F.col("line_hash").alias("key"), F.to_json(F.struct(*replaced.columns)).alias("record"), stamp.alias("archived_at"), F.lit(0).cast("long").alias("batch_id")))
        self.replace("documents", reconcile.tag_orphans(records, states, name))
        self.log("reconcile", file=name, **counts)
        return counts


def version() -> str:
    return __version__


def export_json(df: DataFrame) -> list[dict]:
    """Small results as plain objects."""
    return [json.loads(x) for x in df.toJSON().collect()]
