"""The training-data operators against brute force, on small tables with nulls, ties, copies and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def corpus(seed=5, n=60):
    """(doc_id, text): nulls, empty texts, copies, near copies, shared passages, repeated rows."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefé") for _ in range(draw.randint(1, 6))) for _ in range(300)]
    passage = " ".join(draw.choice(vocabulary) for _ in range(60))
    base = [draw.choice(vocabulary) for _ in range(200)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "a b c d")]
    for i in range(5, n):
        kind = i % 6
        own = [draw.choice(vocabulary) for _ in range(draw.randint(1, 150))]
        if kind == 1:
            near = list(base)
            near[draw.randrange(200)] = "edit"
            text = " ".join(near)
        elif kind == 2:
            text = " ".join(base)
        elif kind == 3:
            text = " ".join(own) + "\n" + passage + "  " + " ".join(own[:30])
        else:
            text = draw.choice([" ", "\n"]).join(own)
        rows.append((i, text))
    return [*rows, rows[-1], rows[7]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "score", 1, 0.5) for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, score string, predicted long, lang_pred double").repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


# ---------------------------------------------------------------- 1


def test_top_k(spark):
    from pyspark.sql import functions as F

    from strandlog.llm.topk import top_k, whole_numbers

    draw = random.Random(1)
    rows = [(i, [draw.choice([-1.0, 0.25, 0.5, 1.0, 2.0]) for _ in range(4)]) for i in range(400)]
    rows += [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(400, 500)]  # ties
    bad = [(600, None), (601, [1.0, None]), (602, [float("nan")] * 4), (603, [float("inf")] * 4), (604, []), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + bad + rows[:3]], "vec_id long, embedding array<float>, score string")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k(whole_numbers(df), F.col("vec_id") % 100 == 0, k=7, bins=8, chunk_rows=50, block_rows=2).collect()}
    want = {}
    for q, a in rows:
        if q % 100 == 0:
            best = sorted((-sum(int(1024 * x) * int(1024 * y) for x, y in zip(a, b)), i) for i, b in rows if i != q)[:7]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    few = whole_numbers(df.where("vec_id in (0, 5, 600)"))
    assert top_k(few, F.col("vec_id") % 100 == 0).count() == 1
    assert top_k(few.where("vec_id < 0"), F.col("vec_id") % 100 == 0).count() == 0


# ---------------------------------------------------------------- 2


def cut_brute(rows, window):
    first, out = {}, {}
    for i, t in sorted({r for r in rows}, key=lambda r: (r[0], r[1] or "")):
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first.setdefault(tuple(w[p : p + window]), (i, p)) < (i, p):
                gone[p : p + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("heavy", [2000, 3])
def test_repeated_passages(docs, empty, heavy):
    from strandlog.llm.substrings import remove_repeats

    want = cut_brute(corpus(), 20)
    got = remove_repeats(docs, heavy=heavy, bucket_bytes=2000).collect()
    assert len(got) == len(corpus())
    for r in got:
        n, removed, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"]) == (n, removed)
        assert " ".join(words(r["text"])) == kept
        assert r["score"] == "score"
    assert remove_repeats(empty).count() == 0


# ---------------------------------------------------------------- 3


def test_restoring_words():
    from collections import Counter

    from strandlog.llm.toxicity import Restorer

    grams = Counter()
    for w, n in (("idiot", 5), ("clown", 5), ("stupid", 5), ("the", 50), ("that", 50), ("worthless", 4), ("scum", 4)):
        for i in range(len(w) + 1):
            grams[f"^^{w}$"[i : i + 3]] += n
    r = Restorer(dict(grams))
    for a, b in (("1d10t", "idiot"), ("cl0wn", "clown"), ("i.d.i.o.t", "idiot"), ("idiooot", "idiot"), ("$cum", "scum"), ("the***", "the"), ("that", "that"), ("2023", "2023"), ("", "")):
        assert r.word(a) == b
    assert r.words("the s t u p i d.") >= {"stupid"}
    assert r.words(None) == set() and r.text("I D I O T the") == "idiot the"


def test_restoring_any_length():
    from collections import Counter

    from strandlog.llm.toxicity import Restorer, Scorer

    grams = Counter()
    for w, n in (("idiot", 5), ("stupid", 5), ("the", 50), ("off", 5), ("of", 90), ("worthless", 4), ("worthlessness", 2)):
        for i in range(len(w) + 1):
            grams[f"^^{w}$"[i : i + 3]] += n
    r = Restorer(dict(grams))
    cases = [("wwwooorrrttthhhllleeessssss", "worthless"), ("stuuuuuuuuuuuuuuuuuuuupid", "stupid"), ("w.o.r.t.h.l.e.s.s.n.e.s.s", "worthlessness"), ("st" + "u" * 100_000 + "pid", "stupid")]
    cases += [("1d107", "idiot"), ("1d10+", "idiot"), ("idiiot", "idiot"), ("1,000", "1,000"), ("10:30", "10:30"), ("$100", "$100"), ("***", "***")]
    for a, b in cases:
        assert r.word(a) == b, a
    assert len(r.word("i.d.i.o.t-" * 5000)) <= 25_000
    assert r.words("off") >= {"off"}
    # a doubled letter neither hides a learned word nor takes a learned one away
    scorer = Scorer(dict(grams), {"idiot$": (50, 0), "off$": (50, 0)}, 100, 100)
    assert all(scorer.top(t)[0] > 2 and scorer.top_without(t, 1)[0] > 2 for t in ("the idiiot", "the 1d107", "the off"))


def test_restoring_spaced():
    from collections import Counter

    from strandlog.llm.toxicity import Restorer, Scorer

    grams = Counter()
    for w, n in (("idiot", 5), ("stupid", 5), ("the", 50), ("man", 20), ("a", 90), ("i", 90), ("you", 60), ("is", 40), ("less", 9), ("ass", 3), ("in", 50), ("do", 20)):
        for i in range(len(w) + 1):
            grams[f"^^{w}$"[i : i + 3]] += n
    r = Restorer(dict(grams))
    scorer = Scorer(dict(grams), {"idiot$": (50, 0), "stupid$": (50, 0), "ass$": (50, 0)}, 100, 100)
    cases = ["a s t u p i d man", "y o u i d i o t", "y o u  1 d 1 0 t", "an a s s", "a  s  s", "i\nd\ni\no\nt", "the (i d i o t).", "y o u i s s t u p i d", "i i d i o o o t", "y o u . i . d . i . o . t"]
    for t in cases:
        assert r.words(t) & {"idiot", "stupid", "ass"}, t
        assert scorer.top(t)[0] > 2 and scorer.top_without(t, 1)[0] > 2 and scorer.top(t)[1] == 0, t
    assert r.words("1 2 3 4") == {"1", "2", "3", "4", "1234"} and r.words("- - -") == set() and scorer.top("a i a man 1 0 1 0")[0] == 0
    assert r.text("y o u s t u p i d man") == "you stupid man"
    assert "stupid" in r.words("a b " * 5000 + "s t u p i d")


def test_scores_by_bounds(monkeypatch):
    """The three highest word scores against those of all tokens, with few of them restored, and trigrams against counting
    each word; whole texts and texts cut into pieces."""
    from collections import Counter

    from strandlog.llm import toxicity

    draw = random.Random(21)
    words = ["".join(draw.choice("abdeilmnorstu") for _ in range(draw.randint(3, 9))) for _ in range(3000)]
    plain = [*words, "idiot", "stupid", "off", "scum", "straße", "été", "\u4e00\u4e8c"]
    want = Counter(f"^^{w}$"[i : i + 3] for w in plain for i in range(len(w) + 1) if toxicity.PLAIN.fullmatch(w))
    seen = {"idiot$": (60, 0), "idio": (60, 1), "stup": (50, 1), "off$": (40, 3), "scum$": (40, 2), "a$": (9, 9)}
    seen |= {w + "$": (draw.randint(2, 30), draw.randint(0, 40)) for w in words[:600]} | {w[:4]: (draw.randint(2, 30), draw.randint(0, 40)) for w in words[:300]}

    def token() -> str:
        w = draw.choice([*plain[-7:], "1d10t", "$cum", "idiiiot", "a", "i", "***", "(a", "b).", "''", "İdiot", "ΟΔΟΣ", "٣x", "²", "_s_", *draw.sample(plain, 20)])
        for _ in range(draw.choice([0, 0, 0, 1, 2])):
            at = draw.randint(0, len(w))
            w = w[:at] + draw.choice("01!$*.,ae-éİ") + w[at:]
        return w.upper() if draw.random() < 0.1 else w

    texts = [None, "", " ", "a", "a b", "(i d i o t).", "x\x1cy\x85z\u3000w\xa0q"]
    texts += ["".join(token() + draw.choice([" ", " ", "\n", "\t ", "\x1d", "\u2003"]) for _ in range(draw.randint(0, 60))) for _ in range(250)]
    texts += [" ".join(draw.choice("aeiostd10!") for _ in range(draw.randint(1, 12))) for _ in range(60)]
    texts += [" ".join(x for x in texts if x)]

    def brute(scorer: toxicity.Scorer, text: str | None) -> list[float]:
        low = (text or "").lower()
        values = [scorer._token(t) for t in set(low.split())]
        for m in toxicity.SPACED.finditer(low):
            values += scorer._best(scorer.restorer.apart(m.group()))
        return scorer._top(values)

    def fresh() -> toxicity.Scorer:
        return toxicity.Scorer(dict(want), seen, 100, 100)

    decoded = Counter()
    decode = toxicity.Restorer.decode
    monkeypatch.setattr(toxicity.Restorer, "decode", lambda self, *a: (decoded.update(n=1), decode(self, *a))[1])
    one = fresh()
    expected = [brute(one, t) for t in texts]
    scorer = fresh()
    assert [scorer.top(t) for t in texts] == expected and max(expected)[2] > 2
    assert fresh().tops(texts) == expected
    # signs behind words that cannot score as high as the first three are not restored
    many = "idiot stupid scum " + " ".join(w + x for w in words[1000:] for x in ("$$$", "***"))
    decoded.clear()
    scorer = fresh()
    top = scorer.top(many)
    few = decoded["n"]
    assert top == brute(fresh(), many) and few < 0.1 * (decoded["n"] - few)
    cut = toxicity.pieces
    monkeypatch.setattr(toxicity, "pieces", lambda texts: cut(texts, 300))
    assert fresh().tops(texts) == expected
    monkeypatch.setattr(toxicity.Bounds, "SLOTS", 5)
    assert fresh().tops(texts) == expected
    counted, again = Counter(), Counter()
    for core in (w.strip(toxicity.EDGE) for t in texts for w in (t or "").lower().split()):
        if core and toxicity.PLAIN.fullmatch(core):
            counted.update(f"^^{core}$"[i : i + 3] for i in range(len(core) + 1))
    for _, lows in cut(texts, 300):
        again.update(toxicity.trigrams(toxicity.Tokens.of(lows)))
    assert again == counted == toxicity.trigrams(toxicity.Tokens.of([(t or "").lower() for t in texts]), dense=0)


def test_character_model_whole(spark):
    from collections import Counter

    from strandlog.llm.toxicity import character_model

    draw = random.Random(8)
    texts = [" ".join("".join(chr(draw.randrange(0x4E00, 0x9FA0)) for _ in range(3)) for _ in range(200)) for _ in range(400)]
    want = Counter(f"^^{w}$"[i : i + 3] for t in texts for w in t.split() for i in range(4))
    assert len(want) > 250_000
    assert character_model(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")) == dict(want)


def test_toxicity(spark, docs, empty):
    from strandlog.llm import toxicity

    draw = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        text = " ".join(draw.choice("alpha beta gamma delta eps zeta the of and".split()) + draw.choice(["", "s", "n"]) for _ in range(30))
        bad = i % 4 == 0
        if bad:
            text += " " + draw.choice(["idiot", "1d10t", "i d i o t", "moron", "m0ron"]) + " end"
        rows.append((i, text))
        labels.append((i, int(bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = toxicity.apply(d, scorer).collect()
    truth = dict(labels)
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)
    odd = toxicity.apply(docs, scorer)
    assert odd.count() == docs.count() and odd.where("text is null and predicted = 0").count() == 1
    assert toxicity.apply(empty, scorer).count() == 0
    none = toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.apply(d, none).select("score").distinct().collect()} == {0.0}


# ---------------------------------------------------------------- 4


def test_repetition_measures(docs, empty):
    from collections import Counter

    from strandlog.llm.repetition import judge_repetition, measure

    draw = random.Random(3)
    texts = [t for _, t in corpus()] + [" ".join(draw.choice("abc") for _ in range(draw.randint(1, 90))) for _ in range(80)] + ["x y z\n x y z\nx y z\nq#|", "a " * 100]
    m = measure(pa.array(texts, pa.string()), least=6)

    def covered(w, size):
        seen, hit = Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1)), [0] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                hit[i : i + size] = [1] * size
        return sum(hit)

    for i, t in enumerate(texts):
        w = words(t)
        lines = [x for x in (t or "").split("\n") if words(x)]
        longest = max((k for k in range(1, len(w)) if max(Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)).values()) > 1), default=0)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), covered(w, 8), covered(w, 6), longest)
        assert tuple(int(m[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")) == want
    got = judge_repetition(docs).collect()
    assert len(got) == len(corpus()) and all(r["base_failed"] and not r["kept"] for r in got if len(words(r["text"])) < 20)
    assert judge_repetition(empty).count() == 0


# ---------------------------------------------------------------- 5


def test_sharding(spark, docs, empty):
    from strandlog.llm.sharding import find_splitters, shard_documents, slim_rows

    got = shard_documents(docs, shards=4, cells=3).collect()
    assert len(got) == len(corpus())
    sizes = {}
    for r in got:
        sizes.setdefault(r["shard"], []).append(r)
    for rows in sizes.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    total = sum(r["size"] for r in got)
    largest = max(r["size"] for r in got)
    assert all(abs(sum(r["size"] for r in rows) - total / 4) <= largest for rows in sizes.values())
    by_id = dict(corpus())
    assert all(r["size"] == 16 + len((by_id[r["doc_id"]] or "").encode()) and r["text_crc32"] == zlib.crc32((by_id[r["doc_id"]] or "").encode()) for r in got)
    assert shard_documents(empty).count() == 0
    # one text that is nearly everything: its group is cut by doc_id
    copies = spark.createDataFrame([(i - 50, "same text") for i in range(100)], "doc_id long, text string")
    counts = [r["count"] for r in shard_documents(copies, shards=5, cells=2).groupBy("shard").count().collect()]
    assert sorted(counts) == [20] * 5
    assert find_splitters(slim_rows(copies), []) == []


# ---------------------------------------------------------------- 6 and 7


def test_packing(docs, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from strandlog.llm.packing import WordEncoder, pack_documents

    path = public.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    draw = random.Random(4)
    bits = ["a", "b", " ", "  ", "the", "\n", "é", "😀", "'s", "12", "!!", "<|endoftext|>", "\x1c", " ", "."]
    odd = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 40))) for _ in range(800)] + [None]
    want = [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in odd]
    encoder = WordEncoder(path)
    assert encoder.quick is not None and encoder.encode(odd) == want
    got = pack_documents(docs, path, length=64, windows=4, least_cut=4, merge_rows=5).collect()
    sequences, pieces = {}, {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
        pieces.setdefault(r["doc_id"], []).append(r)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    for i, t in corpus():
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert sum(r["length"] for r in pieces[i]) % len(ids) == 0
        for r in pieces[i]:
            assert r["doc_tokens"] == len(ids) and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    tokens = sum(r["length"] for r in got)
    assert tokens == sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in corpus())
    assert tokens >= 0.9 * 64 * len(sequences)
    assert pack_documents(empty, path).count() == 0


def test_sentencepiece(docs, empty):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    from strandlog.llm.pieces import PieceCoder, encode_documents

    path = public.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    coder = PieceCoder(path, keep=500)
    draw = random.Random(6)
    bits = ["a", "b", "e", " ", "  ", "the", "\n", "\t", "é", "你", "😀", "▁", "ing", "ab", "aa", "0", "!!", "<0x41>", "<s>", "́", "<unk>", "\r\n", "\x00"]
    texts = ["", " ", "▁", "aaaa aaaaaaaaa", *["".join(draw.choice(bits) for _ in range(draw.randint(1, 60))) for _ in range(1500)], *["".join(draw.choice("abcdeinorst h") for _ in range(draw.randint(1, 200))) for _ in range(800)]]
    for t, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids == model.encode(t) and coder.decode(ids) == model.decode(ids)
    assert coder.encode([None]) == [[]] and coder.decode([]) == ""
    got = encode_documents(docs, path, digests=True).collect()
    by_id = dict(corpus())
    assert len(got) == len(corpus())
    for r in got:
        ids = model.encode(by_id[r["doc_id"]] or "")
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest() and r["n_tokens"] == len(ids)
    assert encode_documents(docs, path).where("doc_id = 3").first()["decoded"] == "one"
    assert encode_documents(empty, path).count() == 0


# ---------------------------------------------------------------- 8

PAGE = """<html><body class="x"><header><h1>Site</h1><p>tagline</p></header><nav>menu</nav><div id="cookie-notice">We use cookies</div><div class="wrap">
<main><div class="sidebar"><p>side text</p></div><article class="post-{n}"><header><h1>Title &amp; co</h1><p>by me</p></header><p>One <b>bold</b> text,
 more.<p>Two<br>lines</p><ul><li>item</li></ul><form><p>form</p></form><div class="ad-box">Buy</div><script>var a="<p>no</p>"</script><!-- <p>no</p> -->
<section class="comments"><p>nice</p></section></article></main></div><footer>foot</footer></body></html>"""


@pytest.mark.parametrize("small", [50_000, 0])
def test_pages(spark, small):
    from strandlog.llm.pagetext import extract_pages, host_of

    rows = [(i, f"https://a.example/{i}", PAGE.replace("{n}", str(i))) for i in range(5)]
    rows += [(10, None, None), (11, "odd", ""), (12, "https://b.example/", "just text"), (13, "https://a.example/x", "<div><p>other &lt;layout&gt;"), (14, "https://a.example/y", "<p unclosed"), rows[0]]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in extract_pages(df, small=small).collect()}
    assert got[1]["text"] == "Title & co\n\nOne bold text, more.\n\nTwo lines\n\nitem" and got[1]["n_chars"] == len(got[1]["text"])
    assert [got[i]["text"] for i in (10, 11, 12, 13, 14)] == ["", "", "just text", "other <layout>", ""]
    assert extract_pages(df, small=small).count() == len(rows) and extract_pages(df.where("page_id < 0")).count() == 0
    assert host_of("HTTP://u@A.b:80/x") == "a.b" and host_of("nothing") == ""


# ---------------------------------------------------------------- 9


def link_brute(rows):
    sets = {}
    for i, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(s), label[i]) for i, s in sets.items()}


def test_similar_keys_whole():
    """Every set keeps all keys of the prefix bound, whatever its size and however frequent its shingles are."""
    from strandlog.llm.similar import prefix_keys

    draw = np.random.default_rng(4)
    sets = [np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 4, 100, 156, 2000)]
    begin = np.append(0, np.cumsum([len(x) for x in sets]))
    for frequent in (np.zeros(0, np.uint64), sets[2], np.sort(np.concatenate([sets[2], sets[4][:1900]]))):
        usual, often = prefix_keys(np.concatenate(sets), begin, np.ones(5, bool), 75, frequent)
        sizes = [len(a) + len(b) for a, b in zip(usual.to_pylist(), often.to_pylist())]
        assert sizes == [1, 2, 26, 40, 501]
        assert set(np.array(sum(often.to_pylist(), []), np.int64).view(np.uint64)) <= set(frequent)
        assert len(often[2]) == (26 if len(frequent) else 0) and len(often[4]) == (401 if len(frequent) > 100 else 0)


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"group_tokens": 300, "small": 0}, {"hot": 1, "group_tokens": 300, "roots": 1}, {"hot": 3, "heavy": 8}, {"hot": 1, "heavy": 1000, "tile_bytes": 500, "roots": 2}])
def test_similar(docs, empty, options):
    from strandlog.llm.similar import similar_components

    want = link_brute(corpus())
    got = similar_components(docs, **options).collect()
    assert len(got) == len(corpus())
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    if not options:
        assert similar_components(empty).count() == 0


def test_count_vector_bound():
    from strandlog.llm.similar import _block_labels, candidate_pairs, count_vector

    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 1 << 62, int(draw.integers(1, 400))).astype(np.uint64)) for _ in range(200)]
    sets += [np.unique(np.concatenate([s[: int(0.95 * len(s))], draw.integers(0, 1 << 62, 2).astype(np.uint64)])) for s in sets[:100]]
    size = np.array([len(s) for s in sets])
    label = _block_labels(size, [count_vector(s) for s in sets], 75)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (size[i] + size[j] - both):
                assert label[i] == label[j]
    assert len(np.unique(label)) > 150
    assert list(candidate_pairs(np.zeros((1, 4), np.uint32), np.zeros(1, int), 75)) == []


# ---------------------------------------------------------------- 10


def test_language(spark, docs, empty):
    from strandlog.llm import language

    draw = random.Random(8)
    kinds = {"aa": ["ka", "lo", "mi", "ru"], "bb": ["the", "and", "of", "ing"], "cc": ["ñu", "él", "ción", "os"]}
    rows = [(i, " ".join("".join(draw.choice(v) for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(3, 40))), k) for i in range(240) for k, v in [list(kinds.items())[i % 3]]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.fit(d.where(language.split_rest() != 2), per_language=50)
    found = language.apply(d, net).collect()
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    odd = language.apply(docs, net)
    assert odd.count() == docs.count()
    assert {(r["lang_pred"], r["score"]) for r in odd.where("trim(text) = '' or text is null").collect()} == {("und", 0.0)}
    assert language.apply(empty, net).count() == 0
    assert language.fit(d.where("lang is null")) is None
    assert language.predict(None, ["abc"]) == (["und"], [0.0])
    assert language.predict(net, ["123 !", "ka" * 5000])[0] == ["und", "aa"]


def test_gradients():
    """Backpropagation through time against differences."""
    from strandlog.llm import language

    draw = np.random.default_rng(0)
    way = language.Direction(draw.standard_normal((256, 9)), draw.standard_normal((3, 9)) * 0.5)
    windows = draw.integers(0, 256, (6, 4)).astype(np.uint8)
    ahead = draw.standard_normal((6, 4, 3))
    language_run = lambda: float((language._run(way, windows, True).astype(np.float64) * ahead).sum())
    trace = []
    language._run(way, windows, True, trace)
    d_table, d_inner = language._backward(way, windows, trace, ahead)
    for grad, weights, places in ((d_inner, way.inner, [(0, 0), (1, 4), (2, 8)]), (d_table, way.table, [(int(windows[0, 0]), 1), (int(windows[3, 2]), 7)])):
        for p in places:
            keep, step = weights[p], 1e-3
            weights[p] = keep + step
            up = language_run()
            weights[p] = keep - step
            down = language_run()
            weights[p] = keep
            assert abs((up - down) / (2 * step) - grad[p]) < 2e-2 * max(1.0, abs(grad[p]))


# ---------------------------------------------------------------- cases that once failed


def test_few_words_in_a_slice(spark):
    """A slice of 0 to 25 words in all."""
    from strandlog.llm.similar import similar_components
    from strandlog.llm.substrings import remove_repeats

    for texts in (["x"], ["x", "x"], ["x y"], ["x y z"], ["x y z w", None], [""], [" ".join("abcdefghijklmnopqrstuvwxy"[:n]) for n in (1, 19, 20, 25)]):
        rows = list(enumerate(texts))
        d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        want = cut_brute(rows, 20)
        assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in remove_repeats(d).collect()} == {i: x[:2] for i, x in want.items()}
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_components(d).collect()} == link_brute(rows)


def test_clashing_inner_names(spark):
    from strandlog.llm.substrings import remove_repeats

    d = spark.createDataFrame([(1, "a b", 7, "h", "s"), (None, "a b", 8, None, "t")], "doc_id long, text string, __id long, __hash string, spans string")
    got = remove_repeats(d)
    assert got.columns == [*d.columns, "n_words", "n_removed"]
    assert {(r["__id"], r["__hash"], r["spans"], r["n_removed"]) for r in got.collect()} == {(7, "h", "s", 0), (8, None, "t", 0)}


def test_large_ids(spark):
    from strandlog.llm.common import components

    top = (1 << 63) - 1
    edges = [(top - i, top - i - 1) for i in range(40)] + [(-top, -top + 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {top - i: top - 40 for i in range(41)} | {-top: -top, -top + 5: -top}


def test_null_ids(spark):
    from strandlog.llm.sharding import shard_documents
    from strandlog.llm.similar import similar_components

    d = spark.createDataFrame([(None, "same"), (1, "same"), (None, None), (2, "b"), (None, "a b c")], "doc_id long, text string")
    got = shard_documents(d, shards=2, cells=2).collect()
    assert len(got) == 5 and sorted((r["doc_id"] or 0, r["size"]) for r in got) == [(0, 16), (0, 20), (0, 21), (1, 20), (2, 17)]
    for k in (0, 1):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in similar_components(d).collect()) == [(0, 0, 0), (0, 1, 0), (0, 1, 0), (1, 1, 1), (2, 1, 2)]


def test_splitters_equal_a_sort(spark):
    """The boundaries of the histogram rounds against those of a plain sort, on rows with large groups of equal texts."""
    from strandlog.llm.sharding import ID_BITS, find_splitters, slim_rows

    draw = random.Random(12)
    rows = [(draw.randrange(-1000, 1000), "same " * 30 if i % 3 == 0 else "x" * draw.randrange(200)) for i in range(600)]
    slim = slim_rows(spark.createDataFrame(rows, "doc_id long, text string"))
    keyed = sorted(((r["h"] << ID_BITS) | (r["id"] + (1 << 63)), r["size"]) for r in slim.collect())
    total = sum(s for _, s in keyed)
    targets = [(total * j // 7, 0.0) for j in range(1, 7)]
    for (target, _), key in zip(targets, find_splitters(slim, targets), strict=True):
        below = sum(s for k, s in keyed if k < key)
        nearest = min(abs(sum(s for k, s in keyed if k < edge) - target) for edge in [k for k, _ in keyed] + [1 << 200])
        assert abs(below - target) == nearest


def test_huge_components(spark):
    from pyspark.sql import functions as F

    from strandlog.llm.topk import top_k, whole_numbers

    rows = [(0, [1.0, 2.0]), (1, [1e30, 1.0]), (2, [3.0, -1.0]), (3, [7e5, 7e5]), (4, [-1e300, 0.0]), (5, [0.5, 0.5]), (6, [1e6, 1.0])]
    d = whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    for options in ({}, {"small": 0}):
        got = [tuple(r) for r in top_k(d, F.col("vec_id") % 100 == 0, k=5, **options).orderBy("rank").collect()]
        whole = {i: [int(1024 * x // 1) for x in v] for i, v in rows if max(map(abs, v)) * 1024 <= 2**30 / 2**0.5 - 1}
        want = sorted((-sum(a * b for a, b in zip(whole[0], v)), i) for i, v in whole.items() if i)
        assert got == [(0, k + 1, i, -s) for k, (s, i) in enumerate(want)] and set(whole) == {0, 2, 3, 5}


def test_added_tokens():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from strandlog.llm.packing import WordEncoder

    path = public.path("byte_bpe_50k.json")
    plain, encoder = Tokenizer.from_file(path), WordEncoder(path, added=True)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y  z", "none here", "<|ENDOFTEXT|>", "", None, "<|endoftext| >"]
    want = [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want and np.frombuffer(want[1], "<u4").tolist() == [50256]


def page_of(source):
    from strandlog.llm.pagetext import best_paths, main_text, read_page

    page = read_page(source)
    return main_text(page, [p for p, _ in best_paths(page)])


def test_page_attributes():
    body = "<body><nav>menu</nav><article{}>{}</article></body>"
    kept = "<h2 id='how-to-follow'>A</h2><p>one</p><section id='search'><h2 id=related-work>B</h2><p>two <math><mi>x</mi></math></p></section><ul><li><a>r1</a><li><a>r2</a><li><a>r3</a></ul>"
    for attributes in ("", " class='overflow-hidden'", " aria-hidden='false'", " data-x='hidden'", " style='overflow:hidden'"):
        assert page_of(body.format(attributes, kept)) == "A\n\none\n\nB\n\ntwo x\n\nr1\n\nr2\n\nr3"
    for gone in ("<div hidden>x</div>", "<div aria-hidden=true>x</div>", "<p style='display : none'>x</p>", "<section id=comments><p>x</p></section>", "<div class='post-comments'>x</div>", "<div role=search>x</div>", "<div class=adBox>x</div>"):
        assert page_of(body.format("", kept + gone)) == page_of(body.format("", kept)), gone
    for stays in ("<div class='content-with-sidebar'>x</div>", "<div class=menuscript>x</div>", "<div hidden=until-found>x</div>"):
        assert page_of(body.format("", kept + stays)) == page_of(body.format("", kept)) + "\n\nx", stays


def test_page_depth_and_siblings():
    assert page_of("<div>" * 5000 + "<p>deep</p>" + "</div>" * 5000 + "<p>after") in ("deep", "deep\n\nafter")
    parts = "<div class=intro><p>{}</p></div><div class=story><p>{}</p></div><div class=more><p>{}</p></div>".format("i" * 300, "s" * 1000, "m" * 400)
    menu = "<ul><li><a>aaa</a><li><a>bbb</a><li><a>ccc</a></ul>"
    assert page_of(f"<body><div class=wrap>{menu}{parts}{menu}</div></body>") == "i" * 300 + "\n\n" + "s" * 1000 + "\n\n" + "m" * 400


def test_decoding_equals_search():
    """The Viterbi path against every path of random lattices."""
    import itertools
    from collections import Counter

    from strandlog.llm.toxicity import Restorer, options

    draw = random.Random(13)
    grams = Counter()
    for _ in range(60):
        w = "".join(draw.choice("abilost") for _ in range(draw.randint(1, 6)))
        for i in range(len(w) + 1):
            grams[f"^^{w}$"[i : i + 3]] += draw.randint(1, 9)
    r = Restorer(dict(grams))

    def worth(path):
        total, at, some = sum(s for _, s in path), "^^", False
        for c in "".join(x for x, _ in path):
            if c == " ":
                total += r.cost(at, "$") if at != "^^" else 0.0
                at = "^^"
            else:
                total, at, some = total + r.cost(at, c), at[1] + c, True
        return total + (r.cost(at, "$") if at != "^^" or not some else 0.0)

    for i in range(150):
        lattice = options("".join(draw.choice("ab10$!*lostt.") for _ in range(draw.randint(1, 6))), spaced=i % 2 == 1)
        paths = list(itertools.product(*lattice))
        found = r.decode(lattice)
        best = max(map(worth, paths))
        assert any("".join(x for x, _ in p) == found and abs(worth(p) - best) < 1e-9 for p in paths)


def test_repetition_verdict(spark):
    """Every field and the verdict of op4 by brute force."""
    from collections import Counter

    from strandlog.llm.repetition import judge_repetition

    draw = random.Random(14)
    long_ = [f"w{i}" for i in range(150)]
    texts = [None, "", " ".join(long_ + long_), " ".join(f"u{i}" for i in range(40)), " ".join([*(f"u{i}" for i in range(900)), *long_, *long_])]
    texts += [" ".join(draw.choice("abcdefghijklmnop") * draw.randint(1, 2) for _ in range(draw.randint(1, 120))) for _ in range(60)]
    texts += [" ".join([*(draw.choice(long_) for _ in range(30)), *long_[: draw.randint(5, 40)], "x", *long_[:30]]) for _ in range(40)]
    got = {r["doc_id"]: r for r in judge_repetition(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = words(t)

        def covered(size):
            seen, hit = Counter(tuple(w[j : j + size]) for j in range(len(w) - size + 1)), [0] * len(w)
            for j in range(len(w) - size + 1):
                if seen[tuple(w[j : j + size])] > 1:
                    hit[j : j + size] = [1] * size
            return sum(hit)

        longest = max((k for k in range(1, len(w)) if max(Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)).values()) > 1), default=0)
        failed = len(w) < 20 or 100 * covered(8) > 30 * len(w)
        bad = covered(6) > 0.3 * len(w) or (longest > 100 and 10 * longest > len(w))
        assert (got[i]["base_failed"], got[i]["kept"]) == (failed, not failed and not bad), i
    assert {r["kept"] for r in got.values()} == {True, False} and any(not r["base_failed"] and not r["kept"] for r in got.values())


# ---------------------------------------------------------------- shared


def test_components(spark):
    from strandlog.llm.common import components

    draw = random.Random(9)
    edges = [(draw.randrange(200), draw.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(60)] + [(1000, i) for i in range(1001, 1100)]
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in label.items() if x in got} and set(got) == {x for a, b in edges if a != b for x in (a, b)}


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rows = corpus()
    d = spark.createDataFrame([(i, t, ["aa", "bb"][i % 2], "s", len(t or ""), "own") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    folder = str(tmp_path / "t")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    near = corpus_pipeline.remove_near_duplicates(spark, d, folder)
    assert near.columns == d.columns
    want = link_brute(rows)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted({i for i, (_, c) in want.items() if c == i})
    cut = corpus_pipeline.remove_passages(spark, near, folder)
    assert cut.schema == d.schema and cut.count() == near.count()
    brute = cut_brute([(r["doc_id"], r["text"]) for r in near.collect()], 20)
    assert all(" ".join(words(r["text"])) == brute[r["doc_id"]][2] for r in cut.collect())
    clean = corpus_pipeline.remove_toxic(spark, d, folder)
    assert clean.columns == d.columns and clean.count() == len(rows)
    spoken = corpus_pipeline.identify_language(spark, d, folder, least=0.0)
    assert spoken.columns == d.columns and spoken.count() == sum(bool(re.search(r"[^\W\d_]", t or "")) for _, t in rows)
    assert corpus_pipeline.pack(spark, d, folder).select("doc_id").distinct().count() == len({i for i, _ in rows})


def test_near_duplicates_by_text(spark, tmp_path):
    """Rows that bear one doc_id and several texts, repeated rows, rows without id or words."""
    import corpus_pipeline

    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a, 1), (5, a, 2), (5, b, 3), (5, b, 4), (None, a, 5), (None, a, 6), (7, "", 7), (7, "", 8), (8, None, 9), (9, b + " c", 10), (2, b + " d", 11), (2, b + " e", 12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, __verdict long")
    got = [tuple(r) for r in corpus_pipeline.remove_near_duplicates(spark, d, "").collect()]
    twos = [r for r in got if r[0] == 2]
    assert len(twos) == 1 and twos[0][2] in (11, 12)
    assert sorted(r[2] for r in got if r[0] != 2) == [1, 5, 6, 7, 8, 9]
    assert corpus_pipeline.remove_near_duplicates(spark, d.where("doc_id = 0"), "").count() == 0
    only = corpus_pipeline.remove_near_duplicates(spark, d.where("doc_id = 5 and __verdict > 2"), "")
    assert only.columns == d.columns and only.count() == 1


def test_pipeline_whole(spark, tmp_path):
    """run() over a folder of tables, rows with nulls among them, and over empty tables."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rows = [(i, t, ["aa", "bb"][i % 2]) for i, t in corpus()] + [(None, "no id here", "aa"), (77, None, None)]
    d = spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 0, i % 3 == 0) for i in range(60)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "cast(toxic as int) toxic")
    for name, some in (("whole", True), ("empty", False)):
        folder = str(tmp_path / name)
        (d if some else d.where("false")).write.parquet(f"{folder}/documents.parquet")
        (labels if some else labels.where("false")).write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert bool(got) == some and len({(r["doc_id"], r["start"]) for r in got}) == len(got)
        for r in got:
            assert r["offset"] + r["length"] <= 2048
