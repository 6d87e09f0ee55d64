import hashlib
import json

import pytest
from pyspark.sql import functions as F

from strandlog.errors import AlreadyInitialized, AuthorNotFound, InvalidRecord, NotRevoked, SourceStackError, StagedData
from strandlog.functions import hashing, similarity
from strandlog.ledger import Ledger
from strandlog.operators import provenance, reconcile, reconstruct, tokens
from strandlog.sources import lines, wiki
from strandlog.streaming.track import track_stream


@pytest.fixture()
def ledger(spark, tmp_path):
    return Ledger.init(spark, str(tmp_path / "ledger"))


def test_hashes(spark):
    assert hashing.hash_value({"b": 1, "a": "é"}) == hashlib.sha256('{"a":"é","b":1}'.encode()).hexdigest()
    assert hashing.hash_value("x y") == hashlib.sha256(b"x y").hexdigest()
    with pytest.raises(TypeError):
        hashing.hash_value(3)
    samples = ['{"b": 1, "a": 1e16}', "plain text", "[1, 2]", "12", ' {"x": "\\u001f"}', '"q"', "{broken", "true", ""]
    df = spark.createDataFrame([(s,) for s in samples], "line string")
    for mode in ("raw", "json"):
        got = [r[0] for r in df.select(hashing.line_hash_column(F.col("line"), mode)).collect()]
        assert got == [hashing.line_hash(s, mode) for s in samples]
    one = spark.range(1).select(hashing.author_id_column(F.lit("Ann"), F.lit("a@x")).alias("a"), hashing.section_hash_column(F.lit("p"), F.array(F.lit("2"), F.lit("1")), F.lit("MIT"), F.lit("2024")).alias("s")).first()
    assert one["a"] == hashing.author_id("Ann", "a@x") and one["s"] == hashing.section_hash("p", ["2", "1"], "MIT", "2024")
    assert hashing.safe_filename("a" * 400) != hashing.safe_filename("a" * 401) and len(hashing.safe_filename("a" * 400)) == 200


def test_removal_bytes(spark):
    bits = [0, 1, 0, 1, 1, 0, 0, 1, 0]
    t = spark.createDataFrame([(i, 10, ["s"], "g", bool(b)) for i, b in enumerate(bits)], "pos long, token_count long, sources array<string>, tokenizer string, revoked boolean")
    found = [r["byte"] for r in tokens.removal_bytes(t, "g").orderBy("byte_idx").collect()]
    assert found == [0x9A, 0x00]
    assert tokens.popcount(tokens.removal_bytes(t, "g")).first()[0] == 4
    assert tokens.removal_bytes(t, "other").count() == 0
    ranges = [(r["start"], r["end"]) for r in tokens.token_ranges(t, "g", block=4).orderBy("pos").collect()]
    assert ranges == [(10 * i, 10 * i + 10) for i in range(9)]


def test_authors_sections_tracking(spark, ledger, tmp_path):
    with pytest.raises(AlreadyInitialized):
        Ledger.init(spark, ledger.path)
    a, b = ledger.add_author("Ann", "ann@x"), ledger.add_author("Bob", "bob@x")
    assert ledger.add_author("Ann", "ann@x") == a and ledger.table("authors").count() == 2
    with pytest.raises(InvalidRecord):
        ledger.add_author("", "x")
    with pytest.raises(AuthorNotFound):
        ledger.register_section("raw/x", ["nobody"], "MIT", "2024")
    s1 = ledger.register_section("raw/1", ["Ann"], "MIT", "2024")
    s2 = ledger.register_section("raw/2", ["bob@x", a], "", "2023")
    data = spark.createDataFrame([("keep", 3), ("drop", 4), ("both", 5)], "text string, n long")
    with pytest.raises(SourceStackError):
        ledger.track(data, "d.jsonl")
    with ledger.source("raw/1"):
        ledger.track(data.where("text <> 'both'"), "d.jsonl", text_column="text", token_count="n", tokenizer="g")
    with pytest.raises(StagedData):
        ledger.check_compact()
    ledger.track(data.where("text = 'both'"), "d.jsonl", [s1, s2], text_column="text", token_count="n", tokenizer="g")
    again = ledger.track(data.where("text = 'both'"), "d.jsonl", [s2, s1], text_column="text")
    assert [r["written"] for r in again.collect()] == [False]
    ledger.compact()
    assert ledger.table("documents").count() == 3
    assert sorted(r["pos"] for r in ledger.table("tokens").collect()) == [0, 1, 2]
    assert ledger.show(author="Bob").count() == 1 and ledger.show(license="MIT").count() == 3 and ledger.show(section=s2).count() == 1
    assert tokens.token_totals(ledger.token_show("g", author="Ann")).first()["total_tokens"] == 12
    text = ledger.export_copyright(str(tmp_path / "out" / "copyright")).collect()
    assert len(text) == 4 and any("Copyright: 2023 Bob <bob@x>\nCopyright: 2023 Ann <ann@x>\nLicense: UNKNOWN" in r["block"] for r in text)
    assert (tmp_path / "out" / "copyright").read_text().count("Files: ") == 4

    # revoking sets, restoring brings back; nothing else changes
    assert ledger.revoke(section=s2) == 1 and ledger.revoke(section=s2) == 0
    assert ledger.show().count() == 2 and ledger.show(revoked=True).count() == 1
    assert ledger.revoke(section=s2, restore=True) == 1 and ledger.show().count() == 3
    assert ledger.revoke(section="missing") == 0
    with pytest.raises(InvalidRecord):
        ledger.revoke(line_hash="x")
    assert ledger.revoke(author="Bob", tokenizer="g") == 1
    assert tokens.token_status(ledger.current("tokens"), "g").first()["revoked"] == 1
    path = str(tmp_path / "mask.bin")
    ledger.removal_set("g", path)
    assert sum(bin(x).count("1") for x in open(path, "rb").read()) == 1

    # purge and its reverse
    file = tmp_path / "d.txt"
    file.write_text("keep\n\ndrop\nother\n")
    assert ledger.revoke(line_hash=hashing.hash_value("drop"), file="d.jsonl") == 1
    out = str(tmp_path / "purged")
    assert ledger.purge(str(file), out, dry_run=True)["purged"] == 1
    assert ledger.purge(str(file), out) == {"purged": 1, "kept": 2, "archived": 1}
    assert [r[0] for r in spark.read.text(out).collect()] == ["keep", "other"]
    assert ledger.purge_reverse(str(file), out, str(tmp_path / "back")) == 1
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "back")).collect()) == ["drop", "keep", "other"]
    with pytest.raises(NotRevoked):
        ledger.purge(str(file), out, author="Ann")

    # archive is idempotent, the log is newest first
    n = ledger.table("archive").count()
    ledger.archive_revoked()
    m = ledger.table("archive").count()
    ledger.archive_revoked()
    assert ledger.table("archive").count() == m >= n
    ops = [r["op"] for r in ledger.query_log().collect()]
    assert ops[0] == "purge" and ops[-1] == "author.add"
    assert ledger.build_index().first()["sections"] == 2
    assert {r["layer"]: r["total"] for r in ledger.status().collect()}["documents"] == 3

    # absorbing is idempotent
    other = Ledger.init(spark, str(tmp_path / "other"))
    counts = other.absorb(ledger)
    assert counts["authors"] == (2, 0) and counts["documents"] == (3, 0) and counts["tokens"] == (3, 0)
    assert other.absorb(ledger)["documents"] == (0, 3)
    assert b != a


def test_reconcile(spark, ledger, tmp_path):
    ledger.add_author("Ann", "ann@x")
    s = ledger.register_section("raw/1", ["Ann"], "MIT", "2024")
    old = spark.createDataFrame([("line one", [1.0, 0.0]), ("line two", [0.0, 1.0])], "text string, e array<double>")
    ledger.track(old, "f.txt", [s], text_column="text", embedding="e", model="m")
    ledger.compact()
    import os

    path = os.path.join(ledger.path, "f.txt")
    with open(path, "w") as f:
        f.write("line one\n\nline 2\nline one\nunrelated\n")
    vectors = {"line 2": [0.1, 0.99], "unrelated": [0.7, 0.7]}
    counts = ledger.reconcile(path, encode=lambda texts: [vectors[t] for t in texts], threshold=0.85)
    assert counts == {"matched": 1, "new": 2, "duplicate": 1, "orphan": 1, "moved": 1}
    new = provenance.lookup_record(ledger.table("documents"), hashing.hash_value("line 2")).first()
    assert new["source_type"] == "reconcile" and new["sources"] == [s]
    assert ledger.blame(path, 3).first()["line_hash"] == hashing.hash_value("line 2")


def test_nearest_and_cosine(spark):
    v = "id string, seq long, embedding array<double>"
    old = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [1.0, 0.0]), ("z", 2, [0.0, 0.0])], v)
    new = spark.createDataFrame([("n1", 1, [0.9, 0.1]), ("n2", 2, [1.0, 0.0])], v)
    best = reconcile.nearest_old(new, old, block_rows=1)
    assert {(r["new_id"], r["old_id"]) for r in best.collect()} == {("n1", "a"), ("n2", "a")}
    assert [(r["new_id"], r["old_id"]) for r in reconcile.match_moved(best, 0.5).collect()] == [("n1", "a")]
    assert similarity.cosine_of([0, 0], [1, 1]) == 0.0
    with pytest.raises(ValueError):
        similarity.cosine_of([1], [1, 2])
    edge = spark.range(1).select(similarity.character_jaccard(F.lit(""), F.lit("")).alias("a"), similarity.character_jaccard(F.lit(""), F.lit("x")).alias("b"), similarity.line_jaccard(F.lit("a\n\nb"), F.lit("b\r\nc")).alias("c")).first()
    assert (edge["a"], edge["b"]) == (1.0, 0.0) and abs(edge["c"] - 1 / 3) < 1e-9


def test_sources(spark, tmp_path):
    file = tmp_path / "x.jsonl"
    file.write_text('{"id": "1", "name": "a"}\n{broken\n\n{"id": "2", "name": "b"}\r\n')
    from strandlog import schemas

    assert sorted(r["id"] for r in lines.read_json_lines(spark, str(file), schemas.AUTHORS).collect()) == ["1", "2"]
    assert lines.read_json_lines(spark, str(file), schemas.AUTHORS, keep_bad=True).count() == 3
    assert lines.read_text_lines(spark, str(file)).count() == 3 and lines.read_text_lines(spark, str(tmp_path / "none")).count() == 0
    numbered = lines.numbered_lines(spark, str(file))
    assert sorted(r["line_no"] for r in numbered.collect()) == [1, 2, 4]
    assert [r["line_no"] for r in lines.slice_lines(numbered, 1, 2).collect()] == [2]
    (tmp_path / "tok").mkdir()
    for n, counts in ((10, [5]), (2, [1, 2])):
        (tmp_path / "tok" / f"{n}").write_text("".join(json.dumps({"token_count": c, "sources": ["s"], "tokenizer": "g"}) + "\n" for c in counts))
    got = lines.read_token_files(spark, str(tmp_path / "tok"), "g").orderBy("pos").collect()
    assert [(r["pos"], r["token_count"]) for r in got] == [(0, 1), (1, 2), (2, 5)]


WIKI = """<mediawiki xmlns="http://x"><page><title>A &amp; B</title><ns>0</ns>
<revision><timestamp>2020-01-01T00:00:00Z</timestamp><contributor><username>Zed</username></contributor><text bytes="3">one
two
</text></revision>
<revision><timestamp>2021-01-01T00:00:00Z</timestamp><contributor><ip>1.2.3.4</ip></contributor><text bytes="3">one
2
</text></revision></page>
<page><title>Talk</title><ns>1</ns><revision><timestamp>2020</timestamp><text>x</text></revision></page>
<page><title>No name space</title><revision><timestamp>2019-05-05</timestamp><contributor><username>Zed</username></contributor><text>hi</text></revision></page></mediawiki>"""


def test_wiki(spark, tmp_path):
    file = tmp_path / "dump.xml"
    file.write_text(WIKI)
    pages = wiki.parse(spark, "mediawiki", str(file))
    info = {r["title"]: r for r in wiki.page_info(pages).collect()}
    assert set(info) == {"A & B", "No name space"}
    assert info["A & B"]["contributors"] == ["Zed", "1.2.3.4"] and info["A & B"]["year"] == "2021"
    authors, sections = wiki.registered(pages, "CC")
    assert {r["email"] for r in authors.collect()} == {"Zed@mediawiki", "1.2.3.4@mediawiki"}
    assert {(r["path"], len(r["authors"])) for r in sections.collect()} == {("raw/A & B", 2), ("raw/No name space", 1)}
    wiki.write_split(pages, str(tmp_path / "split"))
    assert len(list((tmp_path / "split").iterdir())) == 2
    assert wiki.registered(pages, "CC", blame=True)[1].count() == 2
    revisions = [{"timestamp": "1", "contributor": "a", "text": "x\ny\n", "sha1": "p"}, {"timestamp": "3", "contributor": "c", "text": "x\nnew\nz\n", "sha1": "q"}, {"timestamp": "2", "contributor": "b", "text": "x\ny\nz\n", "sha1": "r"}, {"timestamp": "4", "contributor": "d", "text": "ignored", "sha1": "q"}]
    assert wiki.attribute_lines(revisions) == [("x\n", "a"), ("new\n", "c"), ("z\n", "b")]
    assert wiki.attribute_lines([]) == []
    text = "intro " * 100 + "\n== One ==\n" + "a " * 300 + "\n== small ==\nshort\n== 参考 ==\n" + "r " * 300 + "\n=== not ===\n"
    parts = wiki.split_sections(text, "T")
    assert [p["heading"] for p in parts] == ["[INTRO]", "One+small"] and parts[1]["source_path"] == "raw/T#One+small" and parts[1]["start_line"] == 2
    assert wiki.split_sections("  ") == []
    assert wiki.strip_markup("'''b''' [[x]] {{t}} <ref>r</ref>* y") == "b x   y"


def test_reconstruct(spark):
    sources = spark.createDataFrame([(0, "abc"), (1, "abd"), (2, "abc")], "seq long, text string")
    records = spark.createDataFrame([("x", "abc"), ("y", "abz"), ("z", "qqq"), ("e", "")], "rec_id string, text string")
    got = {r["rec_id"]: (r["source_seq"], round(r["confidence"], 3), r["exact"]) for r in reconstruct.match_records(records, sources).collect()}
    assert got == {"x": (2, 1.0, True), "y": (0, 0.5, False), "z": (None, 0.0, False), "e": (None, 0.0, False)}
    lined = reconstruct.match_records(records, sources, similarity=similarity.line_jaccard)
    assert lined.where("rec_id = 'x'").first()["confidence"] == 1.0
    sweep = reconstruct.threshold_sweep(spark.createDataFrame([(0.9, True, True), (0.4, False, True), (0.6, False, False)], "confidence double, correct boolean, has_truth boolean"), [0.5, 0.8])
    assert reconstruct.best_threshold(sweep).first()["threshold"] == 0.8
    edits = [reconstruct.simulate_edits(records.repartition(k)).orderBy("rec_id").collect() for k in (1, 3)]
    assert edits[0] == edits[1]


def test_streaming(spark, ledger, tmp_path):
    ledger.add_author("Ann", "ann@x")
    s = ledger.register_section("raw/1", ["Ann"], "MIT", "2024")
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text('{"text": "a", "n": 1}\n{"text": "b", "n": 2}\n')
    for _ in range(2):
        stream = spark.readStream.schema("text string, n long").json(str(folder))
        track_stream(stream, ledger, "s.jsonl", [s], str(tmp_path / "ck"), text_column="text", token_count="n", tokenizer="g").awaitTermination()
    ledger.compact()
    assert ledger.table("documents").count() == 2 and ledger.table("tokens").count() == 2


def test_rows_hash_as_their_lines(spark, tmp_path):
    """A tracked row with null, nested and double fields hashes as its own JSON line, so that a purge finds the line."""
    import json

    from strandlog.ledger import Ledger
    from strandlog.sources.lines import numbered_lines

    rows = [{"x": None, "b": {"z": 1, "a": [1.5, None]}, "v": 1e16, "t": "a\x1f\"é"}, {"x": "y", "b": {"z": None, "a": None}, "v": 100.0, "t": "b"}, {"x": "keep", "b": None, "v": -0.0, "t": None}]
    path = str(tmp_path / "d.jsonl")
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)
    df = spark.createDataFrame([(r["x"], (r["b"]["a"], r["b"]["z"]) if r["b"] else None, r["v"], r["t"]) for r in rows], "x string, b struct<a: array<double>, z: long>, v double, t string")
    plain = df.select("x", "t")
    h = [r[0] for r in df.select(hashing.object_hash_column(df.schema.fields)).collect()]
    assert sorted(h) == sorted(r["line_hash"] for r in numbered_lines(spark, path).collect()) == sorted(hashing.hash_value(r) for r in rows)
    assert sorted(r[0] for r in plain.select(hashing.object_hash_column(plain.schema.fields)).collect()) == sorted(hashing.hash_value({"x": r["x"], "t": r["t"]}) for r in rows)
    ledger = Ledger.init(spark, str(tmp_path / "ledger"))
    ledger.add_author("Ann", "ann@x")
    bad = ledger.register_section("raw/a", ["Ann"], "MIT", "2024")
    ledger.track(df.where("x is null or x = 'y'"), "d.jsonl", sources=[bad])
    ledger.compact()
    ledger.revoke(section=bad)
    assert ledger.show(revoked=True).count() == 2 and ledger.show().count() == 0
    assert ledger.blame(path, 1).count() == 1


def test_markup_in_the_jvm(spark):
    from strandlog.sources import wiki

    texts = ["=<b>=x", "\u3000 ''b'' [[x|y]] {{t}}\r {{u\rv}} <ref>r</ref>* y \x1c\n", "{|a|-b|--}", "<br/>[[[z]]] ]]", "== H ==\n# one\n;: d", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(wiki.strip_markup_column(F.col("t"))).collect()]
    assert got == [wiki.strip_markup(t) for t in texts] and got[0] == "==x"


def test_lines_are_numbered_across_splits(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    want = []
    for name in ("a.txt", "b.txt"):
        own = [f"{name} {i} " + "x" * (i % 50) if i % 7 else "" for i in range(3000)]
        (folder / name).write_text("\n".join(own) + "\n")
        want += own
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = lines.numbered_lines(spark, str(folder))
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 8
        assert {r["line_no"]: r["line"] for r in rows.collect()} == {i + 1: x for i, x in enumerate(want) if x}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_batch_is_merged_once(spark, ledger, tmp_path):
    ledger.add_author("Ann", "ann@x")
    s = ledger.register_section("raw/1", ["Ann"], "MIT", "2024")
    data = spark.createDataFrame([("a", 1), ("b", 2)], "text string, n long")
    track = lambda df, batch: ledger.track(df, "s.jsonl", [s], text_column="text", token_count="n", tokenizer="g", batch=batch)
    for batch in ("stream-000000000004", "mine"):
        for _ in range(2):  # the second time after the first was compacted
            track(data, batch)
            ledger.compact()
    track(data, "stream-000000000003")
    assert ledger.staged() == []
    assert sorted(r["pos"] for r in ledger.table("tokens").collect()) == [0, 1, 2, 3]
    assert ledger.table("documents").count() == 2
    # a failure after the rows were published and before their folder was deleted
    import shutil

    track(data, None)
    held = ledger.staged("tokens")[0]
    shutil.copytree(held, tmp_path / "held")
    ledger.compact()
    assert ledger.table("tokens").count() == 6
    shutil.copytree(tmp_path / "held", held)
    assert ledger.staged("tokens") == []
    ledger.compact()
    assert ledger.table("tokens").count() == 6


def test_appends_write_their_own_rows(spark, ledger):
    from strandlog import ledger as module

    row = lambda i: spark.createDataFrame([(i, "line", "k", None, None, "revoke")], "seq long, level string, key string, file string, tokenizer string, action string")
    ledger.append("events", row(0))
    first = ledger._manifest("events")["parts"]
    ledger.append("events", row(1))
    assert ledger._manifest("events")["parts"][:1] == first  # untouched
    ledger.append("events", row(2).where("false"))
    assert len(ledger._manifest("events")["parts"]) == 2
    for i in range(2, module.FAN + 2):
        ledger.append("events", row(i))
    assert len(ledger._manifest("events")["parts"]) < module.FAN
    assert sorted(r["seq"] for r in ledger.table("events").collect()) == list(range(module.FAN + 2))


def test_purge_in_place(spark, ledger, tmp_path):
    ledger.add_author("Ann", "ann@x")
    s = ledger.register_section("raw/1", ["Ann"], "MIT", "2024")
    ledger.track(spark.createDataFrame([("drop",)], "text string"), "d.txt", [s], text_column="text")
    ledger.compact()
    ledger.revoke(section=s)
    file, folder = tmp_path / "d.txt", tmp_path / "d"
    file.write_text("b\ndrop\na\n")
    folder.mkdir()
    (folder / "part-0").write_text("z\ndrop\n")
    (folder / "part-1").write_text("drop\ny\n")
    assert ledger.purge(str(file), dry_run=True) == {"purged": 1, "kept": 2, "archived": 0}
    assert ledger.purge(str(file)) == {"purged": 1, "kept": 2, "archived": 1}
    assert file.read_text() == "b\na\n"
    assert ledger.purge(str(file)) == {"purged": 0, "kept": 2, "archived": 0} and file.read_text() == "b\na\n"
    assert ledger.purge(str(folder)) == {"purged": 2, "kept": 2, "archived": 2}
    assert [r["line"] for r in lines.numbered_lines(spark, str(folder)).orderBy("line_no").collect()] == ["z", "y"]
    assert not [p for p in tmp_path.iterdir() if ".kept-" in p.name or p.name.endswith(".before")]
    out = str(tmp_path / "back")
    assert ledger.purge_reverse(str(file), str(file), out) == 1
    assert [r["line"] for r in lines.numbered_lines(spark, out).orderBy("line_no").collect()] == ["b", "a", "drop"]


def test_lookups_and_embedding(spark, ledger, tmp_path):
    from strandlog.errors import NotFound

    ledger.add_author("Ann", "ann@x")
    s = ledger.register_section("raw/1", ["Ann"], "MIT", "2024")
    data = spark.createDataFrame([("one", 3, [1.0, 0.0]), ("two", 5, [0.0, 1.0])], "text string, n long, e array<double>")
    ledger.track(data.limit(1), "f.txt", [s], text_column="text", token_count="n", tokenizer="g", embedding="e", model="m")
    with pytest.raises(StagedData):
        ledger.embedding(hashing.hash_value("one"), "m")
    ledger.compact()
    assert ledger.embedding(hashing.hash_value("one"), "m") == [1.0, 0.0]
    with pytest.raises(NotFound):
        ledger.embedding(hashing.hash_value("one"), "other")
    assert ledger.token_entry("g", 0)["token_count"] == 3
    for bad in (1, -1):
        with pytest.raises(NotFound):
            ledger.token_entry("g", bad)
    file = tmp_path / "f.txt"
    file.write_text("one\ntwo\n\ntwo\n")
    assert ledger.embed(str(file), lambda texts: [[0.5] for _ in texts], "m") == 1
    assert ledger.embed(str(file), lambda texts: [[0.5] for _ in texts], "m") == 0
    assert {r["model"]: r["embeddings"] for r in ledger.embedding_counts().collect()} == {"m": 2}
    ledger.build_index()
    assert [r["pos"] for r in ledger.source_positions("g", s).collect()] == [0]
    assert ledger.lookup(s).first()["refs"] == [hashing.hash_value("one")[:2]] and ledger.lookup("none").count() == 0


def test_source_records_and_counts(spark, tmp_path):
    sections = spark.createDataFrame([("h", "raw/A", ["id"], "MIT", "2024")], "section_hash string, path string, authors array<string>, license string, year string")
    found = {r["title"]: r for r in reconstruct.source_records(sections, spark.createDataFrame([("raw/A", "x"), ("raw/B", "y")], "path string, text string")).collect()}
    assert found["A"]["section_hash"] == "h" and found["B"]["license"] is None and found["A"]["text_hash"] == hashlib.sha256(b"x").hexdigest()
    sweep = reconstruct.threshold_sweep(spark.createDataFrame([(0.9, True, True), (0.4, False, True)], "confidence double, correct boolean, has_truth boolean"), [0.3, 0.8])
    assert [(r["recall"], r["precision"]) for r in reconstruct.precision_recall(sweep).collect()] == [(0.5, 1.0), (1.0, 0.5)]
    file = tmp_path / "x.jsonl"
    file.write_text('{"id": "1"}\n{broken\n')
    from strandlog import schemas

    assert tuple(lines.bad_lines(spark, str(file), schemas.AUTHORS).first()) == (2, 1)
    assert tuple(lines.bad_lines(spark, str(tmp_path / "none"), schemas.AUTHORS).first()) == (0, 0)
    dump = tmp_path / "dump.xml"
    dump.write_text(WIKI)
    pages = wiki.parse(spark, "mediawiki", str(dump))
    assert wiki.parse_counts(*wiki.registered(pages, "CC"), pages).first().asDict() == {"pages": 2, "authors": 2, "sections": 2}


def test_http_encoder_retries_and_checks(monkeypatch):
    import io
    import urllib.error
    import urllib.request

    answers = [urllib.error.HTTPError("u", 503, "busy", {}, None), {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}, {"data": [{"index": 0, "embedding": [1.0]}]}, urllib.error.HTTPError("u", 404, "none", {}, None)]

    def answer(*_, **__):
        one = answers.pop(0)
        if isinstance(one, Exception):
            raise one
        return io.BytesIO(json.dumps(one).encode())

    monkeypatch.setattr(urllib.request, "urlopen", answer)
    encode = reconcile.http_encoder("http://x", "m", pause=0)
    assert encode(["a", "b"]) == [[1.0], [2.0]]
    with pytest.raises(InvalidRecord):
        encode(["a", "b"])
    with pytest.raises(urllib.error.HTTPError):
        encode(["a"])
