"""Whole queries against plain versions of their contracts."""

import collections
import hashlib
import math
import re
import zlib

import pytest

from __spark_entry__ import queries

SMALL = "/root/testdata/sf0.001"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@pytest.fixture(scope="module")
def result(spark):
    return lambda name: queries()[name](spark, SMALL).collect()


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_secrets(result, texts):
    for r in result("op1_secret_scan"):
        t, spans = texts[r.doc_id] or "", []
        for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
            spans += [(m.start(), 0, "assign", m.end())] * (len(m[2]) >= 6)
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans.sort()
        assert r.base_sha256 == digest((k, a, b) for a, _, k, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in spans) for k in ("assign", "access", "hex"))
        assert {f"{k}:{a}:{b}" for a, _, k, b in spans} <= set(r.spans.split(","))


def test_quality(result, texts):
    for r in result("op2_quality_rules"):
        t = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        many = collections.Counter(grams)
        covered = {i + j for i, g in enumerate(grams) if many[g] > 1 for j in range(3)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_pages(spark, result):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    from html import unescape

    rows = result("op4_main_text")
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("(?s)<article>(.*?)</article>", pages[r.page_id])[1]
        blocks = (" ".join(unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:h1|p)>", article))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_shards(result, texts):
    slots = collections.defaultdict(list)
    for r in result("op5_hash_tree_shards"):
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key") and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(40))


def test_items_in_texts_are_found(spark, result, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    plain = lambda t: " ".join((t or "").encode().translate(LOWER).decode().split())
    held = {(d, i) for d, t in texts.items() for i, x in items.items() if plain(x) in plain(t)}
    got = {(r.doc_id, r.item_id): r.similarity for r in result("op6_decontamination")}
    assert held and all(got.get(pair) == 1.0 for pair in held)


def test_lines(result, texts):
    seen, gone = [], {}
    index, counts = collections.defaultdict(list), collections.Counter()
    lines = [
        (d, i, frozenset(line.split())) for d in sorted(texts)
        for i, line in enumerate((texts[d] or "").encode().translate(LOWER).split(b"\n"))
    ]
    for _, _, s in lines:
        counts.update(s)
    for d, i, s in lines:
        if not s:
            continue
        rare = sorted(s, key=lambda w: (counts[w], w))[: len(s) - math.ceil(0.8 * len(s)) + 1]
        if any(5 * len(s & seen[c]) >= 4 * len(s | seen[c]) for c in {c for w in rare for c in index[w]}):
            gone.setdefault(d, []).append(i)
        for w in rare:
            index[w].append(len(seen))
        seen.append(s)
    rows = result("op7_line_dedup")
    assert len(rows) == len(texts) and sum(r.n_removed for r in rows) > 0
    for r in rows:
        assert r.removed == ",".join(map(str, gone.get(r.doc_id, [])))


def test_packing(result, texts):
    bins, words = collections.defaultdict(list), collections.Counter()
    for r in result("op8_best_fit_packing"):
        bins[r.bin].append(r)
        words[r.doc_id] += r.piece_words
    assert all(words[d] == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in texts.items()) and len(words) == len(texts)
    for rows in bins.values():
        assert len({r.source for r in rows}) == len({r.cluster for r in rows}) == len(rows)
        at = 0
        for r in sorted(rows, key=lambda r: r.bin_start):
            assert r.bin_start == at
            at += r.piece_words
        assert at <= 1024


def test_components(result, texts):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().translate(LOWER).split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 5 >= 4 * max(len(sets[a]), len(sets[b])):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    for r in result("op9_ngram_jaccard"):
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id))


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def test_personal_data(result, texts):
    for r in result("op10_personal_data"):
        t = texts[r.doc_id] or ""
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        spans += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
        spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
        assert r.base_sha256 == digest(spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone"))


def test_passages(result, texts):
    """Runs of 50 words that an earlier document holds word for word lie inside the passages returned."""
    words = {d: (t or "").encode().translate(LOWER).split() for d, t in texts.items()}
    first, need = {}, collections.defaultdict(set)
    for d in sorted(words):
        for i in range(len(words[d]) - 49):
            if first.setdefault(tuple(words[d][i : i + 50]), d) != d:
                need[d].update(range(i, i + 50))
    got = collections.defaultdict(set)
    for r in result("op3_repeated_passages"):
        got[r.doc_id].update(range(r.start_word, r.end_word))
        assert r.end_word - r.start_word >= 50
        assert r.matched >= 0.8 * max(r.end_word - r.start_word, r.first_end - r.first_start)
    assert need and all(len(n & got[d]) >= 0.95 * len(n) for d, n in need.items())
