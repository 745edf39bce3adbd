"""Periodic runs, cross-tokenizer alignment and suffix-array dedup against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from surveyeval.llm import cross_tokens, periodic_runs, suffix_array, suffix_dedup

SPACE = r"[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, runs int, kept string, n_a int, row long, body string"  # clash with made and internal names


def rows(texts):
    return [(i, t, 0, "k", 0, 0, "b") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- periodic runs


def brute_runs(w, least=24, repeats=3):
    out = []
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, repeats * q):
                seg = w[i : i + length]
                if not any(all(seg[x] == seg[x + r] for x in range(length - r)) for r in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts():
    rng = random.Random(3)
    texts = ["", None, " \n ", "a " * 23, "a " * 24, "a b " * 12, "é ü " * 20 + "ß", " ".join(f"w{i}" for i in range(40)) * 1]
    texts += [" ".join([f"p{i}" for i in range(q)] * 3) for q in (7, 8, 9, 16, 17, 33, 64)] + [" ".join(([f"p{i}" for i in range(q)] * 3)[:-1]) for q in (8, 9, 40)]
    for _ in range(60):
        w = []
        while len(w) < rng.randint(10, 300):
            unit = [rng.choice("abcd") for _ in range(rng.randint(1, 40))]
            w += (unit * rng.randint(1, 6))[: rng.randint(1, 160)]
        texts.append(" ".join(w))
    return [*texts, texts[-1]]


def test_periodic_runs(spark, none):
    texts = periodic_texts()
    out = {r["doc_id"]: r for r in periodic_runs.periodic_runs(spark.createDataFrame(rows(texts), SCHEMA).repartition(3)).collect()}
    assert len(out) == len(texts) and set(out[0].asDict()) == {"doc_id", "text", "kept", "n_a", "row", "body", "n_words", "runs", "collapsed"}
    for i, t in enumerate(texts):
        w = (t or "").split()
        want = brute_runs(w)
        assert [tuple(r) for r in out[i]["runs"]] == want and out[i]["n_words"] == len(w) and out[i]["collapsed"] == collapsed(w, want)
    assert sum(len(r["runs"]) for r in out.values()) > 60
    assert periodic_runs.periodic_runs(none).count() == 0


def test_periodic_runs_long(spark):
    """A text of one word, and a long period inside a long text: pairs grow with the words, not with their square."""
    unit = [f"u{i % 900}.{i}" for i in range(3000)]
    texts = ["x " * 60_000, " ".join(unit * 4 + ["end"]), " ".join((["a"] * 40 + unit[:500]) * 5)]
    out = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic_runs.periodic_runs(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert out[0] == [(0, 60_000, 1)] and out[1] == [(0, 12_000, 3000)]
    assert out[2] == sorted([(0, 2700, 540)] + [(540 * i, 40, 1) for i in range(5)])


def test_op11(spark, tmp_path):
    """The query plants its tails by crc32 of the id and digests every run; null ids plant nothing."""
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(20 + 7 * i % 400)) for i in range(120)] + ["", None]
    held = [(1000 + i, t) for i, t in enumerate(texts)] + [(None, "a " * 30)]
    spark.createDataFrame(held, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in periodic_runs.op11_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for d, t in held:
        w = [x for x in re.split(SPACE, t or "") if x]
        h, n = zlib.crc32(str(d).encode()), len(w)
        if d is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        want = {
            "doc_id": d, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": runs and 1000 * best[1] // best[2] or None,
            "runs_sha256": hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(collapsed(w, runs).encode()).hexdigest(),
        }
        assert got[d].asDict() == want
    assert planted > 4 and sum(r["n_runs"] > 0 for r in got.values()) > 4


# --- cross-tokenizer alignment


def brute_tokens(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{cross_tokens.FOLDER}/{cross_tokens.A_FILE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{cross_tokens.FOLDER}/{cross_tokens.B_FILE}")
    letters = cross_tokens.byte_letters()
    out, count = [], Counter()
    for t in texts:
        tokens = [], []
        if t:
            ids = a.encode(" " + t, add_special_tokens=False).ids
            tokens = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids], [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(t) for p in [b.id_to_piece(i)]]
            if any(b"".join(x for _, x in side) != (" " + t).encode() for side in tokens):
                tokens = [], []
        ranges = []
        for side in tokens:
            at, held = 0, []
            for i, x in side:
                held.append((at, at + len(x), i))
                at += len(x)
            ranges.append(held)
        cuts = sorted({e for _, e, _ in ranges[0]} & {e for _, e, _ in ranges[1]})
        groups = [[[i for s, e, i in side if lo <= s and e <= hi] for side in ranges] for lo, hi in zip([0, *cuts], cuts, strict=False)]
        links = [(x, y) for s, e, x in ranges[0] for u, v, y in ranges[1] if s < v and u < e]
        count.update(set(links))
        out.append((len(ranges[0]), len(ranges[1]), groups, links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for na, nb, groups, links in out:
        spelled = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        yield na, nb, len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(spelled.encode()).hexdigest() if na else ""


MADE = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TOKEN_TEXTS = [
    "", None, " ", "a", "Hello world, hello tokens!", "Hello world, hello tokens!", "aaaaaaaaaaaaaaaaaaaaaaaaa", "das Übermaß der Straße – naïve café", "tab\tand\nnewline  two   three", "<|endoftext|> and <s> </s> <unk> <0x41>", "日本語 текст 🙂🙃",
    "under▁score", "a b　c", "ﬁ ligature ½", "\x00nul\x7f", "x" * 500, "word " * 300, " leading and trailing ", "https://example.org/a/b?c=d&e=f", "don't can't we're I'll 12345 67.89", "antidisestablishmentarianism pneumonoultramicroscopic", "unübersetzbar Donaudampfschifffahrt",
]


@pytest.mark.parametrize("heavy", [cross_tokens.HEAVY, 3])
def test_cross_tokens(spark, none, monkeypatch, heavy):
    """Heavy pairs are looked up, the others joined: equal results whichever they are."""
    monkeypatch.setattr(cross_tokens, "HEAVY", heavy)
    out = {r["doc_id"]: r for r in cross_tokens.cross_alignment(spark.createDataFrame(rows(TOKEN_TEXTS), SCHEMA).repartition(3)).collect()}
    assert {i: tuple(out[i][c] for c in MADE) for i in out} == dict(enumerate(brute_tokens(TOKEN_TEXTS)))
    assert set(out[0].asDict()) == {"doc_id", "runs", "kept", "row", "body", *MADE}
    assert cross_tokens.cross_alignment(none).count() == 0


def test_op12(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    few = [d for d in texts if len(texts[d] or "") < 3000]
    got = {r["doc_id"]: r for r in cross_tokens.op12_cross_tokens(spark, folder).collect()}
    assert len(got) == len(texts)
    own = {r["doc_id"]: r for r in cross_tokens.cross_alignment(spark.createDataFrame([(d, texts[d]) for d in few], "doc_id long, text string")).collect()}
    for d, want in zip(few, brute_tokens([texts[d] for d in few]), strict=True):
        assert tuple(own[d][c] for c in MADE) == want and got[d]["groups_sha256"] == want[6]


def test_both_encoders_agree():
    """The faster encoder gives the tokens of the vocabulary file's own."""
    from tokenizers import Tokenizer

    with open(f"{cross_tokens.FOLDER}/{cross_tokens.A_FILE}", "rb") as file:
        raw = file.read()
    own = Tokenizer.from_str(raw.decode())
    own.encode_special_tokens = True
    fast = cross_tokens.a_encoder(raw, cross_tokens.a_tokens(raw))
    rng = random.Random(5)
    texts = [t for t in TOKEN_TEXTS if t] + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FF), rng.randint(0x400, 0x4FF), 32, 32, 10])) for _ in range(200)) for _ in range(100)]
    assert fast.__self__.__class__.__name__ == "Encoding"
    assert all(fast(" " + t) == own.encode(" " + t, add_special_tokens=False).ids for t in texts)


# --- suffix-array dedup


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        yield len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), bytes(x for x, g in zip(b, gone, strict=True) if not g)


def repeated_texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöü") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(90))
    page = " ".join(word() for _ in range(400))
    texts = ["", None, "a" * 199, "a" * 200, "ab" * 150, "é" * 300, passage, passage, page, page[:700] + "X" + page[701:], page[50:900], passage[:250], passage[:199]]
    texts += [f"{word()} {passage[i : i + 300 + i]} {word()}" for i in range(20)] + [" ".join(word() for _ in range(120)) for _ in range(10)]
    texts += ["".join(c if rng.random() > 0.004 else rng.choice("xyz") for c in page) for _ in range(12)]
    return [*texts, "q" * 900, texts[-1]]


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 2])
def test_suffix_dedup(spark, none, monkeypatch, crowd):
    """Anchors with more segments than a task sorts give the same spans."""
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    texts = repeated_texts()
    out = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows(texts), SCHEMA).repartition(5)).collect()}
    want = dict(enumerate(brute_repeats(texts, 200)))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for i, r in out.items()} == want
    assert any(0 < w[1] < w[0] and w[2] > 1 for w in want.values())
    assert set(out[0].asDict()) == {"doc_id", "text", "runs", "n_a", "row", "body", "kept", "n_bytes", "n_removed", "n_spans"}
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_many_copies_of_one_text(spark):
    """A group of exact copies: what is kept of a text grows with the text, not with the number of its copies."""
    page = " ".join(f"word{i}" for i in range(200))
    df = spark.createDataFrame([(i, page) for i in range(300)], "doc_id long, text string").repartition(6)
    spans = suffix_dedup.repeated_spans(df).collect()
    assert len(spans) == 1 and len(spans[0]["spans"]) < 60
    out = suffix_dedup.remove_repeats(df, with_text=False)
    assert out.columns == ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"]
    assert {(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()} == {(len(page), len(page), 1, b"")}


def test_long_rows_reach_python_in_small_batches(spark, monkeypatch):
    key, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, suffix_dedup.materialize
    before = spark.conf.get(key)

    def noted(df, name="step", schema=None):
        seen[name] = int(spark.conf.get(key))
        return write(df, name, schema)

    monkeypatch.setattr(suffix_dedup, "materialize", noted)
    page = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(0, page), (1, page + "x"), (2, "y" + page)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(df).select("doc_id", "n_removed").collect()} == {i: len(page) for i in range(3)}
    assert max(seen[name] for name in ("anchors", "places", "spans")) <= 1_000 and spark.conf.get(key) == before


def test_a_task_sorts_pieces_of_large_batches(spark, monkeypatch):
    """What is sorted at once does not grow with the rows of a batch."""
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 20)
    monkeypatch.setattr(suffix_dedup, "SLICE", 5_000)
    monkeypatch.setattr(suffix_dedup, "repeated_starts", lambda parts, length: [np.full(len(parts), True) for _ in parts])  # as many flags as parts
    text = bytes(range(250))
    segments = spark.createDataFrame([(a, g, text) for a in range(300) for g in range(2)], "a long, g long, body binary").coalesce(1)
    sizes = {r["spans"][0]["n"] for r in suffix_dedup.sorted_repeats(segments).collect()}
    assert max(sizes) <= 42


def test_op13(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = {d: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for (d, _), (n, gone, spans, kept) in zip(docs, brute_repeats([t for _, t in docs], 200), strict=True)}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.op13_suffix_array_dedup(spark, folder).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0


def test_two_stage_order():
    import numpy as np

    rng = random.Random(7)
    for alphabet in (b"a", b"ab", b"abc", bytes(range(255))):
        for _ in range(60):
            s = bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) + b"\xff"
            depth = rng.choice([8, 16, 24])
            order = suffix_array.suffix_order(np.frombuffer(s, np.uint8), depth).tolist()
            assert sorted(order) == list(range(len(s))) and [s[i : i + depth] for i in order] == sorted(s[i : i + depth] for i in range(len(s)))
