"""Rules, urls, counts, packing and mixing against brute force."""

from __future__ import annotations

import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reliefgrid.llm import bpe_count, minmax_dedup, mixing, packing, quality_lines, url_filter
from reliefgrid.llm.pieces import Cutter
from reliefgrid.llm.stored import stored
from reliefgrid.llm.words import Reader

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NATIVE = re.compile("Python|Pandas|Arrow")


def words(text):
    return WORD.findall(text or "")


def repeats(ws):
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    return len({k for i, w in enumerate(windows) if w in twice for k in range(i, i + 8)})


def normal(line):
    line = re.sub("[0-9]+", "0", line.translate({i: i + 32 for i in range(65, 91)}))
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))


def quality_by_hand(rows):
    lines = [[line for line in (r.text or "").split("\n") if WORD.search(line)] for r in rows]
    normals = [[normal(line) for line in own] for own in lines]
    different = {(r.source or "", r.text or ""): set(own) for r, own in zip(rows, normals, strict=True)}
    hosts = Counter(host for host, _ in different)
    seen = Counter((host, line) for (host, _), own in different.items() for line in own)
    common = {k for k, n in seen.items() if n > quality_lines.MIN_DOCS and n > quality_lines.MAX_HOST_SHARE * hosts[k[0]]}
    out = []
    for r, own, norm in zip(rows, lines, normals, strict=True):
        ws = words(r.text)
        removed = sum(len(words(a)) for a, b in zip(own, norm, strict=True) if (r.source or "", b) in common)
        failed = len(ws) < 20 or 100 * repeats(ws) > 30 * len(ws)
        kept = not failed and not len(ws) - removed < quality_lines.MIN_LEFT_SHARE * len(ws)
        symbols = sum(c in "#*$%&|<>" for c in r.text or "")
        out.append((r.doc_id, len(ws), sum(map(len, ws)), symbols, len(own) - len(set(own)), repeats(ws), removed, failed, kept))
    return common, out


def test_quality(docs, rows):
    common, want = quality_by_hand(rows)
    assert len(common) >= 2
    got = quality_lines.quality_verdicts(docs)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed", "base_failed", "kept"]
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want)
    assert not NATIVE.search(got._jdf.queryExecution().executedPlan().toString())


def test_quality_applied(docs, rows):
    common, want = quality_by_hand(rows)
    got = quality_lines.apply_rules(docs)
    assert got.columns == docs.columns
    kept = Counter()
    for r, w in zip(rows, want, strict=True):
        if w[-1]:
            left = [x for x in r.text.split("\n") if not (WORD.search(x) and (r.source or "", normal(x)) in common)]
            kept[(r.doc_id, "\n".join(left) if w[6] else r.text)] += 1
    assert Counter((r.doc_id, r.text) for r in got.collect()) == kept
    assert got.where("row != 'clash'").isEmpty()


HEADER = "Home of good news and of things to buy\nAbout us, our shops, our people\nContact: call 555 1234 or come by"


def test_boilerplate_of_several_lines(spark):
    """A header of three lines goes whole from every page of its host, pages that are hardly more go too, and copies do not count."""
    rng = random.Random(4)
    body = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    pages = [(k, f"{HEADER}\n{body(30 if k < 40 else 2)}", "host") for k in range(50)]
    others = [(100 + k, f"{HEADER}\n{body(30)}", "other") for k in range(5)]
    copied = [(200 + k, "one line of a text that was copied very often indeed\n" + "and its other line with enough words to count as a text", "host") for k in range(30)]
    numbers = [(300 + k, f"{HEADER}\n{k} {k} {k} {k}", "host") for k in range(10)]
    docs = spark.createDataFrame(pages + others + copied + numbers, "doc_id long, text string, source string").repartition(4)
    got = {r.doc_id: r for r in quality_lines.quality_verdicts(docs).collect()}
    removed = len(words(HEADER))
    assert {got[k].n_removed for k in range(50)} == {removed}
    assert all(got[k].kept for k in range(40)) and not any(got[k].kept for k in range(40, 50))
    assert {got[k].n_removed for k in range(100, 105)} == {0} and {got[k].n_removed for k in range(200, 230)} == {0}
    assert not any(got[k].kept for k in range(300, 310)) and {got[k].n_removed for k in range(300, 310)} == {removed + 4}
    left = {r.doc_id: r.text for r in quality_lines.apply_rules(docs).collect()}
    assert set(left) == {*range(40), *range(100, 105), *range(200, 230)}
    assert all(left[k] == pages[k][1].split("\n")[3] for k in range(40))


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "https://a.b.NET/x?y#z", "https://example.net/en/1", "https://example.net/en",
    "https://www.example.com/de/1", "https://example.com/fr/", "https://x.org/fr/2", "https://notnet.com/", "https://spam-farm.example.org/fr/1",
    "https://spam-farm.example.org/en/1", "ftp://q://net/", "http://a.net?/x", "http://é.net/é/", "https://example.org/fr",
]


def url_by_hand(url, rules, blocked):
    _, sep, rest = (url or "").partition("://")
    host = re.split("[/?#]", rest)[0].translate({i: i + 32 for i in range(65, 91)}) if sep else ""
    path = re.split("[?#]", rest[len(host) :])[0] if sep else ""
    fits = lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p)
    found = sorted(((len(h + p), h + p, v) for h, p, v in rules if fits(h, p)), reverse=True)
    listed = any(fits(h, p) for h, p in blocked)
    return host, path, found[0][1] if found else None, found[0][2] if found else "block" if listed else "allow"


def test_urls(spark):
    rows = list(enumerate(URLS)) + [(None, "https://example.net/en/1"), (3, "no scheme")]
    pages = spark.createDataFrame([(*r, "html", "h") for r in rows], "page_id long, url string, html string, host string")
    got = url_filter.judge_urls(pages).collect()
    want = [(i, *url_by_hand(u, url_filter.RULES, url_filter.BLOCKED)) for i, u in rows]
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter(want)
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules=[], blocked=[]).collect()} == {"allow"}


def test_url_in_a_query(spark):
    """A second :// after ? or # is no scheme: the path of such a url is empty."""
    urls = ["http://a.net?u=http://b.org/en/x", "http://a.com#http://b.net/de/", "http://a.net/?u=http://b.org/en/x", "http://a.com?u=http://b.net"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert got == {(i, *url_by_hand(u, url_filter.RULES, url_filter.BLOCKED)) for i, u in enumerate(urls)}
    assert {r[2] for r in got} == {"", "/"}


def test_digest_collision(tmp_path, monkeypatch):
    """Entries that share a digest are told apart by their strings."""
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: len(s))
    path = tmp_path / "d.bin"
    path.write_bytes(url_filter.DigestArray.packed([(b"aa/", b"\1"), (b"bb/", b"\2"), (b"bb/", b"\0"), (b"c/", b"\1")]))
    assert url_filter.DigestArray(str(path)).probe([b"aa/", b"bb/", b"dd/", b"c/", b"xxxx"]) == [[b"\1"], [b"\0", b"\2"], [], [b"\1"], []]


ODD = [
    "It's they'll WE'RE 'tis ' s", "x<|endoftext|>y <|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "İstanbul ÀÉ", "日本語 テスト 12345", "ábc é",
    "\x1c\x1d a\x85b\xa0c \xa0 d", "!!'s ''s 's", "ΟΔΟΣ Σ", "naïve ½ ² ١٢", "😀😀 ok", "a'b c'D e'LLx", "  \n\n  a  \t b  ", "a  b\n\nc\n d \n  e", "\n", "   ", "trail  ",
]


@pytest.fixture(scope="module")
def texts(spark, docs):
    rng = random.Random(3)
    odd = ODD + ["".join(rng.choice("abcXYZ 019 \n'!.,-éßñÀs t're\t") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return docs.select("doc_id", "text", "row").unionByName(
        spark.createDataFrame([(5000 + k, t, "x") for k, t in enumerate(odd)], "doc_id long, text string, row string")
    ).cache()


def test_token_counts(texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = Counter()
    for r in texts.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want[(r.doc_id, len((r.text or "").encode()), n, n > 2048)] += 1
    assert Counter(map(tuple, bpe_count.count_tokens(texts, path).collect())) == want
    assert bpe_count.count_tokens(texts.limit(0), path).count() == 0


def test_token_counts_without_table(texts, monkeypatch):
    monkeypatch.setattr(bpe_count, "CACHED_PIECES", 3)
    path = public_tokenizers.path("word_bpe_49k.json")
    few = texts.limit(20)
    got = Counter(map(tuple, bpe_count.count_tokens(few, path).collect()))
    monkeypatch.undo()
    assert got == Counter(map(tuple, bpe_count.count_tokens(few, path).collect()))


@pytest.mark.parametrize("known", [packing.KNOWN_TOKENS, 50])
def test_packing(texts, monkeypatch, known):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "KNOWN_TOKENS", known)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = Counter()
    for r in texts.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        start, piece, size = 0, 0, (len(ids) - 1) % 2048 + 1
        while start < len(ids):
            want[(r.doc_id, piece, start, size, zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes()))] += 1
            start, piece, size = start + size, piece + 1, 2048
    got = packing.pack(texts, path, block_pieces=150).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)])]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.15 * -(-total // 2048) + 4
    assert packing.pack(texts.limit(0), path).count() == 0


def test_sum_of_squares_is_smallest():
    """Every placement is the best of all, worked out from the sums themselves."""
    rng, capacity = random.Random(2), 12
    lengths = [rng.randint(1, 11) for _ in range(120)]
    bins, offsets, n = packing.sum_of_squares(np.array(lengths), capacity)
    gaps: dict[int, int] = {}

    def total(g):
        return sum(c * c for c in Counter(x for x in g.values() if x).values())

    for s, b, o in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
        options = [total(gaps | {k: x - s}) for k, x in gaps.items() if x >= s] + [total(gaps | {len(gaps): capacity - s})]
        assert o == capacity - gaps.get(b, capacity)
        gaps[b] = gaps.get(b, capacity) - s
        assert gaps[b] >= 0 and total(gaps) == min(options)
    assert n == len(gaps)


def entropy(weights):
    return -sum(w * np.log(w) for w in weights if w > 0)


def test_mixing(docs, rows):
    got = mixing.mixture(docs, budget=1.0, entropy_share=0.97, max_passes=None, block_rows=20)
    assert not NATIVE.search(got._jdf.queryExecution().executedPlan().toString())
    out = got.collect()
    assert Counter((r.doc_id, r.source, r.n_tokens) for r in out) == Counter((r.doc_id, r.source, len(words(r.text))) for r in rows)
    tokens = Counter()
    for r in out:
        tokens[r.source] += r.n_tokens
    total, weights = sum(tokens.values()), {r.source: r.weight for r in out}
    exponent = out[0].exponent
    powers = {s: (n / total) ** exponent for s, n in tokens.items()}
    for s, w in weights.items():
        assert w == pytest.approx(powers[s] / sum(powers.values()))
    assert 0 < exponent < 1 and entropy(weights.values()) == pytest.approx(0.97 * np.log(len(tokens)), abs=1e-6)
    longest = max(r.n_tokens for r in out)
    for s, w in weights.items():
        given = sum(r.n_tokens * r.passes for r in out if r.source == s)
        assert int(w * total) <= given + 1 and given <= w * total + longest
        passes = {r.passes for r in out if r.source == s}
        assert len(passes) <= 2 and max(passes) - min(passes) <= 1


def test_mixing_limit_and_cover(docs):
    limited = mixing.mixture(docs, budget=1.0, entropy_share=None, max_passes=1.5).collect()
    by = Counter()
    for r in limited:
        by[r.source] += r.n_tokens
    assert max(r.weight * sum(by.values()) / by[r.source] for r in limited) == pytest.approx(1.5, abs=1e-6)
    cover = mixing.mixture(docs, budget=None, entropy_share=None, max_passes=3.0)
    assert cover.where("passes < 1").isEmpty() and cover.where("passes > 4").isEmpty() and not cover.where("passes > 1").isEmpty()
    out = mixing.mixed_documents(docs, budget=None, entropy_share=None, max_passes=3.0)
    assert out.columns == docs.columns
    want = Counter()
    for r in cover.collect():
        want[r.doc_id] += r.passes
    # equal rows come equally often
    assert {r.doc_id for r in out.collect()} == set(want)
    assert mixing.mixture(docs.limit(0)).count() == 0


def test_empty_quality(docs):
    assert quality_lines.quality_verdicts(docs.limit(0)).count() == 0
    assert quality_lines.apply_rules(docs.limit(0)).count() == 0
    assert docs.select(F.count("*")).first()[0] > 0


def test_python_tasks_hold_little(spark):
    """Whole texts reach Python in small batches, are cut in small slices, and the caller's settings come back."""
    texts = pa.array(["Some words, 12 of them, in a text. " * 120] * 1000)
    reads = (
        lambda: [len(minmax_dedup.shingle_sets(reader, w)) for reader in [Reader(lower=True)] for _, w in reader.slices(texts)],
        lambda: [len(cut.texts) for bare in (False, True) for cut in Cutter(bare, []).slices(texts)],
    )
    for read in reads:
        tracemalloc.start()
        assert sum(read()) in (1000, 2000)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 80e6

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = stored(spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long"), "sizes").collect()
    assert sum(r.n for r in got) == 2500 and max(r.n for r in got) <= 1000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
