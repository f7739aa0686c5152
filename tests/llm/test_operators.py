"""The ten operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from panelspark.llm import chunk_dedup, cube, decision_list, decontam, exchange, fuzzy_lines, icws, neardup, ngram_trie, orc_tokens, semicrf, url_lr
from panelspark.llm import text as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "é ü\tß", "same text of six words here", "same text of six words here", "long " * 20000]


def low(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, a repeated row, a null id, copies and altered copies, and extra columns whose names clash with the operators' own."""
    r = random.Random(4)
    texts = list(ODD) + [words(r, r.randint(20, 90)) for _ in range(60)]
    for i in range(20):
        w = texts[len(ODD) + i].split()
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    rows = [(i, t, f"s{i % 4}" if i % 9 else None, "x", 1.0, i) for i, t in enumerate(texts)]
    rows += [rows[12], (None, texts[13], "s1", "x", 1.0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string, weight double, n_tokens int").repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def test_words_and_hashes():
    texts = [None, "", "A bc\x0bd", " é  日本 ", "x" * 50]
    t = X.texts_of(pa.array(texts))
    w = X.words_of(t)
    assert [t.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)] == [x for s in texts for x in WORD.findall(s or "")]
    assert np.diff(w.first).tolist() == [0, 0, 3, 2, 1]
    # Hashes don't depend on where a word stands, also past the table of powers.
    far = X.Texts(np.frombuffer(b"y" * (X.SLICE_BYTES + 100) + b" word", np.uint8), np.array([0, X.SLICE_BYTES + 105]))
    near = X.Texts(np.frombuffer(b"word", np.uint8), np.array([0, 4]))
    assert X.word_hashes(far, X.words_of(far))[-1] == X.word_hashes(near, X.words_of(near))[0]


def test_packing():
    r = np.random.default_rng(1)
    for n in (0, 1, 1000):
        v = r.integers(0, 1 << 40, n).astype(np.uint64)
        assert (exchange.unpack(exchange.pack(v)) == v).all()
        assert (exchange.unpack_sorted(exchange.pack_sorted(np.sort(v))) == np.sort(v)).all()


def test_lm_scores(docs, none):
    got = ngram_trie.score_documents(docs, block_tokens=300).collect()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert len(got) == len(rows)
    toks = [(i, [*WORD.findall(low(t)), 0]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c1, c2, c3 = (collections.Counter() for _ in range(3))
    n = 0
    for i, t in toks:
        if not held(i):
            n += 1
            p = [1, 1, *t]
            c1.update(t)
            c2.update(zip(p[1:], p[2:]))
            c3.update(zip(p, p[1:], p[2:]))
    N, V = sum(c1.values()), len(c1)
    want = collections.defaultdict(list)
    for i, t in toks:
        base = score = 0.0
        p = [1, 1, *t]
        for u, v, w in zip(p, p[1:], p[2:]):
            p1 = (c1[w] + 0.1) / (N + 0.1 * (V + 1))
            p2 = (c2[v, w] + 20 * p1) / ((n if v == 1 else c1[v]) + 20)
            p3 = (c3[u, v, w] + 20 * p2) / ((n if v == 1 else c2[u, v]) + 20)
            base, score = base + math.log10(p1), score + math.log10(p3)
        want[i].append((len(t), sum(c1[w] > 0 for w in t), base, score))
    for r in got:
        m, known, base, score = want[r.doc_id][0]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (m, known, N, held(r.doc_id))
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and abs(r.score - score) < 5e-4 * m
    assert ngram_trie.score_documents(none).count() == 0


def test_trie_round_trip(tmp_path):
    r = np.random.default_rng(3)
    V = 50
    pairs = sorted({(int(a), int(b)) for a, b in r.integers(0, V, (400, 2))})
    f, s = (np.array(x) for x in zip(*pairs))
    at = {p: i for i, p in enumerate(pairs)}
    tri = sorted({(at[a, b], at[b, c]) for a, b in pairs for c in r.integers(0, V, 3).tolist() if (b, c) in at})
    up, down = (np.array(x) for x in zip(*tri))
    p1, b1, p2, b2, p3 = (-r.random(n) * 5 for n in (V, V, len(f), len(f), len(up)))
    t = ngram_trie.NGramTrie.build(p1, b1, f, s, p2, b2, up, down, p3)
    t.write(str(tmp_path / "trie"))
    for trie in (t, t.mapped(), ngram_trie.NGramTrie.open(str(tmp_path / "trie"))):
        u, v, w = r.integers(0, V, (3, 3000))
        known = {(pairs[a][0], pairs[a][1], pairs[b][1]): x for a, b, x in zip(up, down, p3)}
        for a, b, c, x in zip(u.tolist(), v.tolist(), w.tolist(), trie.log10(u, v, w)):
            two = p2[at[b, c]] if (b, c) in at else b1[b] + p1[c]
            want = known[a, b, c] if (a, b, c) in known else two + (b2[at[a, b]] if (a, b) in at else 0)
            assert abs(x - want) < 1e-3


def test_decontamination(spark, none):
    r = random.Random(5)
    items = [words(r, r.randint(12, 70)) for _ in range(40)]
    texts = []
    for i in range(200):
        t = words(r, r.randint(0, 150))
        if i % 4 == 0:
            at = r.randint(0, len(t))
            t = f"{t[:at]} {items[i % 40].upper() if i % 8 else items[i % 40]}. {t[at:]}"
        elif i % 4 == 1:
            t += " " + " ".join(items[i % 40].split()[:5])  # a short piece isn't a leak
        texts.append(t)
    d = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string, item_id double")
    b = spark.createDataFrame([*((i, t) for i, t in enumerate(items)), (77, None), (78, ""), (0, items[0])], "item_id long, text string")
    want = {(i, i % 40) for i in range(0, 200, 4)}
    assert {(x.doc_id, x.item_id) for x in decontam.find_contamination(d, b).collect()} == want
    # A smaller index makes more passes with the same result, scores included.
    whole, sliced = ({(x.doc_id, x.item_id, round(x.score, 9)) for x in decontam.find_contamination(d, b, index_chars=n).collect()} for n in (32_000_000, 4000))
    assert whole == sliced
    kept = decontam.drop_contaminated(d, b)
    assert kept.columns == d.columns and {x.doc_id for x in kept.collect()} == set(range(202)) - {i for i, _ in want}
    assert decontam.find_contamination(none, b).count() == 0 and decontam.find_contamination(d, b.limit(0)).count() == 0


def test_repeated_passages(spark, docs, none):
    t = X.texts_of(pa.array(["hello world, this is a gear", "", "zz", "hello world"]))
    g = chunk_dedup.gear_hashes(t)
    for d in range(len(t)):
        h = 0
        for i, b in enumerate(t.raw(d)):
            h = ((h << 1) + int(chunk_dedup.GEAR[b])) & 0xFFFFFFFF
            assert h & 0xFFFFF == int(g[t.offsets[d] + i]) & 0xFFFFF
    r = random.Random(1)
    passages = [words(r, 55) for _ in range(40)]
    rows, first = [], {}
    for i in range(240):
        x = words(r, r.randint(20, 120))
        if i % 2 == 0:
            at = r.randint(0, len(x))
            x = f"{x[:at]} {passages[i // 2 % 40]} {x[at:]}"
            first.setdefault(i // 2 % 40, i)
        rows.append((i, x))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = chunk_dedup.repeated_spans(df, block_chunks=700).collect()
    assert {x.doc_id for x in got} == {i for i in range(0, 240, 2) if i != first[i // 2 % 40]}
    cut = {x.doc_id: x.text for x in chunk_dedup.remove_spans(df, spark.createDataFrame(got)).collect()}
    one = got[0]
    text = rows[one.doc_id][1]
    assert cut[one.doc_id] == text[: one.start] + text[one.end :] or sum(x.doc_id == one.doc_id for x in got) > 1
    assert all(cut[i] == rows[i][1] for i in range(1, 240, 2))
    chunk_dedup.repeated_spans(docs).collect()
    assert chunk_dedup.repeated_spans(none).count() == 0


def test_statistics_and_rules(spark, docs):
    r = random.Random(2)
    texts = [*ODD, "a b c d e a b c d e", "é ü #1\né ü #1\n\n", *("".join(r.choice(["a", "b ", " ", "\n", "é ", "c", "|", "日 "]) for _ in range(r.randint(0, 80))) for _ in range(400))]
    got = decision_list.statistics(X.texts_of(pa.array(texts, pa.string())))
    for i, x in enumerate(texts):
        w = WORD.findall(x or "")
        runs = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = collections.Counter(runs)
        inside = {j for k, q in enumerate(runs) if n[q] > 1 for j in range(k, k + 5)}
        lines = [s for s in (x or "").split("\n") if WORD.search(s)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), len(lines) - len(set(lines)), len(inside))
        assert tuple(int(got[c][i]) for c in decision_list.COUNTS) == want
    d = spark.createDataFrame([(i, words(r, 40).replace(" ", " | " if i % 3 == 0 else " ")) for i in range(300)], "doc_id long, text string")
    labels = d.selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS quality").where("doc_id < 240")
    rules = decision_list.learn_from(d, labels)
    out = decision_list.judge(d, rules, keep=["doc_id"]).collect()
    assert rules and all(x._kept == (x.doc_id % 3 != 0) for x in out)  # held-out rows too
    assert decision_list.learn_from(d, labels.limit(0)) == []
    every = decision_list.judge(docs, [], keep=docs.columns).collect()
    assert len(every) == docs.count() and all(not x._kept for x in every if not (x.text or "").strip())


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/1?x#y", "https://a.example.com/en/2", "http://x.net/es/3", "ftp://x.net/fr?q", "http://x.com", "http://x.com/", None, "", "no scheme", "a://b://c/d", "http://EXAMPLE.org#f/en/"]
    urls += [f"https://shop{i}.example.net/es/{i}" for i in range(30)] + [f"https://shop{i}.example.com/de/{i}" for i in range(30)]
    p = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = sorted(url_lr.judge_urls(p).collect(), key=lambda x: x.page_id)
    for x, u in zip(got, urls):
        at = (u or "").find("://")
        rest = u[at + 3 :] if u and at >= 0 else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = low(host)
        fits = [(h + q, v) for h, q, v in url_lr.RULES if (host == h or host.endswith("." + h)) and path.startswith(q)]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (x.host, x.path, x.rule) == (host, path, rule) and (verdict is None or x.verdict == verdict) and x.verdict in ("allow", "block")
    own = spark.createDataFrame([(f"http://bad{i}.org/x/{i}", "block") for i in range(60)] + [(f"http://fine{i}.org/y/{i}", "allow") for i in range(60)], "url string, label string")
    test = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'fine'}{i + 500}.org/{'x' if i % 2 else 'y'}/{i}") for i in range(40)], "page_id long, url string")
    assert all((x.verdict == "block") == bool(x.page_id % 2) for x in url_lr.judge_urls(test, labelled=own).collect())
    assert url_lr.judge_urls(p.limit(0)).count() == 0


def brute_classes(docs, least=0.8, floor=0):
    rows = [(i, t or "") for i, t in docs]
    bags = {}
    for i, t in rows:
        w = WORD.findall(low(t))
        bags[t] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()
    df = collections.Counter(k for _, t in rows for k in bags[t])
    idf = {k: math.log(1 + len(rows) / max(n, floor * len(rows))) for k, n in df.items()}
    texts = [t for t in bags if bags[t] and any(i is not None for i, u in rows if u == t)]
    ids = {t: min(i for i, u in rows if u == t and i is not None) for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for k, a in enumerate(texts):
        for b in texts[:k]:
            x, y = bags[a], bags[b]
            both = sum(min(x[q], y[q]) * idf[q] for q in x.keys() & y.keys())
            if both >= least * (sum(x[q] * idf[q] for q in x) + sum(y[q] * idf[q] for q in y) - both):
                p, q = sorted((find(a), find(b)), key=ids.get)
                root[q] = p
    least_id = {}
    for t in texts:
        least_id[find(t)] = min(least_id.get(find(t), 1 << 60), ids[t])
    return sorted(((i, least_id[find(t)] if t in root else i) for i, t in rows), key=str)


def test_near_duplicates(docs, none):
    got = sorted(((r.doc_id, r.class_id) for r in icws.near_duplicates(docs).collect()), key=str)
    assert got == brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    kept = icws.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({c for i, c in got if i == c and i is not None})
    assert icws.near_duplicates(none).count() == 0


def test_sampling_estimates_similarity():
    r = np.random.default_rng(2)
    keys = r.integers(0, 1 << 44, 400).astype(np.uint64)
    a, b = np.sort(keys[:300]), np.sort(keys[60:])
    doc = np.repeat([0, 1], [300, 340])
    v = icws.sample(doc, np.concatenate([a, b]), np.ones(640), 2)
    assert abs((v[0] == v[1]).mean() - 240 / 400) < 0.15


def test_personal_data(spark, none):
    E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    P, C, I4 = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")

    def brute(t):
        out = [("email", *m.span()) for m in E.finditer(t)] + [("ip", *m.span()) for m in I4.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [("card", *m.span()) for m in C.finditer(t) if 13 <= len(re.sub("[ -]", "", m[0])) <= 19 and semicrf.luhn(re.sub("[ -]", "", m[0]))]
        return out + [("phone", *m.span()) for m in P.finditer(t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]

    r = random.Random(3)
    for _ in range(8000):
        t = "".join(r.choice(["a", "B", ".", ".", "@", "@", "-", "+", "1", "22", "255", "4", "0", "(", ")", " ", " ", "é", "_", "%", "4111111111111111", "300"]) for _ in range(r.randint(0, 24)))
        assert semicrf.base_spans(t) == brute(t)
    field = semicrf.Field().fit(semicrf.examples())
    hit = wrong = missed = 0
    for t, gold in semicrf.examples(150, 99):
        found, gold = set(field.decode(t)), set(gold)
        hit, wrong, missed = hit + len(found & gold), wrong + len(found - gold), missed + len(gold - found)
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.95
    texts = [*ODD, "write to a.b@c.example.org or +1 (555) 010-1234, é 4111 1111 1111 1111 from 10.0.0.1", 'key = "0123456789abcdef0123456789abcdef01234567" ok']
    d = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {x.doc_id: x for x in semicrf.find_personal_data(d, field=field).collect()}
    assert (got[9].n_email, got[9].n_phone, got[9].n_card, got[9].n_ip) == (1, 1, 1, 1)
    assert got[10].spans == "secret:7:47" and got[0].spans == got[1].spans == ""
    for i, t in enumerate(texts):
        assert set(filter(None, semicrf.digest(brute(t or "")).split(","))) <= set(got[i].spans.split(","))
    assert semicrf.find_personal_data(none, field=field).count() == 0


def changed(r, s, n=1):
    """``s`` with ``n`` characters changed."""
    s = list(s)
    for k in r.sample(range(len(s)), n):
        s[k] = "é" if s[k] != "é" else "日"
    return "".join(s)


def line_sets(s):
    """The runs of a line's characters, of each kind it has by its length."""
    return {size: {low(s)[k : k + size] for k in range(max(1, len(s) - size + 1))} for size, ok in ((4, len(s) < 80), (8, len(s) >= 64)) if ok}


def like(a, b):
    """Lines of one kind whose runs have a Jaccard similarity of 0.8."""
    return any(5 * min(len(a[k]), len(b[k])) >= 4 * max(len(a[k]), len(b[k])) and 10 * len(a[k] & b[k]) >= 8 * len(a[k] | b[k]) for k in a.keys() & b.keys())


def brute_lines(rows):
    lines = [(-1 if i is None else i, k, s) for i, t in rows for k, s in enumerate((t or "").split("\n")) if WORD.search(s)]
    texts = sorted({s for *_, s in lines})
    root, sets = list(range(len(texts))), [line_sets(s) for s in texts]

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if like(a, sets[j]):
                root[find(i)] = find(j)
    of, group = {s: find(i) for i, s in enumerate(texts)}, collections.defaultdict(list)
    for i, k, s in lines:
        group[of[s]].append((i, k))
    return {(x, min(v)) for v in group.values() if len(v) > 1 for x in v}


def test_fuzzy_lines(spark, none):
    r = random.Random(6)
    base = [words(r, n)[: r.choice([40, 62, 70, 79, 80, 90, 400])] for n in [r.randint(8, 70) for _ in range(90)]] + [words(r, 600)]
    rows = []
    for i in range(60):
        lines = [r.choice(base) for _ in range(3)] + ["", "x", "short", "日本", changed(r, r.choice(base)), r.choice(base).replace("a", "b", 1).upper(), changed(r, r.choice(base), 3), words(r, 20)]
        rows.append((i, "\n".join(lines), 5))
    rows += [(60, None, 1), (61, "", 1), (None, base[0], 1), (3, rows[3][1], 2), (62, changed(r, base[-1], 60), 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, line int").repartition(3)
    got = {((-1 if x.doc_id is None else x.doc_id, x.line), (-1 if x.first_doc_id is None else x.first_doc_id, x.first_line)) for x in fuzzy_lines.fuzzy_lines(d).collect()}
    assert got == brute_lines([(i, t) for i, t, _ in rows])
    assert ((62, 0), min(x for x, first in got if first == dict(got)[(62, 0)])) in got
    assert fuzzy_lines.fuzzy_lines(none).count() == 0


def test_lines_in_blocks(monkeypatch):
    """Lines have the same ids, bands and sets however many characters are worked on at once."""
    r = random.Random(8)
    lines = [words(r, r.randint(1, 60)) for _ in range(40)] + ["", " ", " \t", "\t a", "  é日本", "日本" * 30, "x", words(r, 900)]
    r.shuffle(lines)
    t = X.texts_of(pa.array(["\n".join(lines), None, "", "\n".join(lines[::-1])]))

    def all_of():
        start, end, doc, number = fuzzy_lines.lines_of(t)
        x, y = fuzzy_lines.places(t.data, start, end)
        points = fuzzy_lines.characters(t.data)
        some = [np.flatnonzero(y - x < fuzzy_lines.BELOW), np.flatnonzero(y - x >= fuzzy_lines.FROM)]
        marked = pa.array([m + t.data[a:b].tobytes().decode() for m in "sl" for a, b in zip(start.tolist(), end.tolist())])
        bands = [fuzzy_lines.bands(points, x[k], y[k], kind) for k, kind in zip(some, fuzzy_lines.KINDS)]
        return [start, end, doc, number, *fuzzy_lines.identified(t, start, end, y - x), *bands, *fuzzy_lines.sets(marked)]

    whole = all_of()
    assert [(d, n) for d, n in zip(whole[2], whole[3])] == [(d, n) for d, s in ((0, lines), (3, lines[::-1])) for n, x in enumerate(s) if WORD.search(x)]
    for block in (1, 50, 1000):
        monkeypatch.setattr(fuzzy_lines, "BLOCK", block)
        assert all(np.array_equal(a, b) for a, b in zip(whole, all_of()))


def test_unlike_lines_are_told_apart_by_bits():
    r = random.Random(9)
    base = [words(r, n) for n in range(2, 80)]
    lines = sorted({s for b in base for s in (b, changed(r, b), changed(r, b, 2), b + " " + words(r, 1))})
    c = neardup.Compared(fuzzy_lines.sets(pa.array(["l" + s for s in lines])), len(lines))
    i, j = np.triu_indices(len(lines), 1)
    near, alike = c.near(i, j, 0.8), c.similarity(i, j)
    assert c.plain and near[alike >= 0.8].all() and (alike >= 0.8).sum() > 100
    assert near[alike < 0.2].mean() < 0.1


def test_short_lines_with_one_change(spark):
    """A changed year, counter or letter leaves a line of 39 characters and more alike."""
    r = random.Random(7)
    base = [(words(r, 30))[:n] for n in (39, 45, 60, 63, 64, 78, 79, 80, 81, 120)]
    rows = [(0, "\n".join(base)), (1, "\n".join(changed(r, s) for s in base))]
    got = {(x.doc_id, x.line): (x.first_doc_id, x.first_line, x.kept) for x in fuzzy_lines.fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, k): (0, k, i == 0) for i in (0, 1) for k in range(10)}


def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.json")


def test_encoder():
    from tokenizers import Tokenizer

    e, t = orc_tokens.Encoder(tokenizer()), Tokenizer.from_file(tokenizer())
    r = random.Random(1)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "B", "it's", "'s", "1", "23", "!", "...", "\u00a0", "\u2003", "\u3000", "é", "ß", "日本", "😀", "<|endoftext|>", "_", "\x1c", "\x85", "\u200b", "\x00", "end. ", "x,y;", "\x0b"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(2000)] + [None, "", " "]
    # In pieces, with a memory that is too small, and whole, as for a tokenizer that splits in another way.
    assert e.cuts
    for remembered, cuts in ((orc_tokens.REMEMBERED, True), (300, True), (100, True), (orc_tokens.REMEMBERED, False)):
        was, orc_tokens.REMEMBERED, e.cuts = orc_tokens.REMEMBERED, remembered, cuts
        for a in range(0, len(texts), 40):
            ids, first = e.encode(X.texts_of(pa.array(texts[a : a + 40], pa.string())))
            for i, x in enumerate(texts[a : a + 40]):
                assert ids[first[i] : first[i + 1]].tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 2]
        orc_tokens.REMEMBERED = was


def test_orc_round_trip(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    path = f"file://{tmp_path}/orc"
    got = sorted(orc_tokens.token_digests(docs, tokenizer(), path).collect(), key=lambda x: x.start)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    at = 0
    for x, (i, text) in zip(got, rows, strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert (x.doc_id, x.start, x.n_tokens, x.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    one = orc_tokens.read_tokens(spark, path).where("doc_id = 5")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)" in one._jdf.queryExecution().toString() and one.count() == 1
    assert orc_tokens.token_digests(none, tokenizer()).count() == 0


def test_targets():
    out = cube.targets({"a": 100, "b": 10, "c": 1000, None: 5})
    assert math.isclose(sum(out.values()), 1115) and out["b"] == 30 and out["a"] == 300 and out[None] == 15
    assert cube.targets({}) == {} and cube.targets({"a": 0, "b": 0}) == {"a": 0, "b": 0}


def test_flight_keeps_totals():
    r = np.random.default_rng(4)
    p, size = np.full(500, 0.37), r.integers(1, 3000, 500).astype(float)
    q = cube.flight(p, size, r.random(1100))
    assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q.sum() - p.sum()) < 1e-6 and abs((q - p) @ size) < 1e-3
    hits = sum(cube.flight(np.full(40, 0.25), size[:40], np.random.default_rng(k).random(100))[7] == 1 for k in range(400))
    assert 60 < hits < 140  # the probability of each is kept on average


def test_mix(spark, docs, none):
    got = cube.mix_sources(docs, keep=["doc_id"], block_rows=7).collect()
    rows = docs.collect()
    size = collections.Counter()
    for r in rows:
        size[r.source] += len(WORD.findall(r.text or ""))
    want = cube.targets(dict(size))
    assert len(got) == len(rows)
    longest = max(len(WORD.findall(r.text or "")) for r in rows)
    taken = collections.Counter()
    for x in got:
        assert 0 <= x._mix_copies <= 3
        taken[x._mix_source_size, round(x._mix_target, 6)] += x._mix_size * x._mix_copies
    for s, n in size.items():
        assert abs(taken[n, round(want[s], 6)] - want[s]) <= longest
    again = cube.mix_sources(docs, keep=["doc_id"], block_rows=7).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert cube.take_mix(docs).columns == docs.columns
    assert cube.mix_sources(none).count() == 0
    with pytest.raises(ValueError):
        cube.mix_sources(docs.withColumnRenamed("score", "_mix_p"))


def test_pipeline_stages(spark):
    """Each stage on what the stage before kept, at the smallest size."""
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    now = c.table(spark, sf, "documents")
    assert [n for n, _ in c.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "token_output"]
    for name, stage in c.STAGES[:-1]:
        after = stage(spark, now, sf)
        assert after.columns == c.COLUMNS
        before, rows = {r.doc_id: r for r in now.collect()}, after.collect()
        assert all(before[r.doc_id] == r for r in rows) and rows
        if name == "near_dedup":
            classes = brute_classes([(i, r.text) for i, r in before.items()])
            assert sorted(r.doc_id for r in rows) == sorted({k for i, k in classes})
        now = spark.createDataFrame(rows, now.schema)
    last = c.STAGES[-1][1](spark, now, sf)
    assert last.count() == now.count()


def test_large_bucket_of_items_that_are_not_alike(spark):
    """One true pair among many items of one bucket that are all rather alike."""
    from panelspark.llm import neardup

    r = random.Random(8)
    stem = [f"stem{k}" for k in range(80)]
    texts = [" ".join([*stem, *(f"own{i}x{k}" for k in range(13))]) for i in range(300)]  # 80 of 106 words: 0.75
    twin = texts[123].split()
    twin[80:90] = [f"twin{k}" for k in range(10)]  # 83 of 103: 0.81
    texts.append(" ".join(twin))
    r.shuffle(texts)

    def sets(column):
        t = X.texts_of(column)
        w = X.words_of(t)
        key = np.unique((w.doc.astype(np.uint64) << np.uint64(44)) | (X.word_hashes(t, w) >> np.uint64(20)))
        return neardup.Sets((key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1), np.ones(len(key), np.int64), np.ones(len(key)))

    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    items = rows.selectExpr("id", "array(7L, 8L) AS bands")
    want = sorted(i for i, x in enumerate(texts) if x in (" ".join(twin), " ".join([*stem, *(f"own123x{k}" for k in range(13))])))
    for part in (1000, 90):
        neardup.GROUP_ROWS, was = part, neardup.GROUP_ROWS
        try:
            got = neardup.group(items, lambda ids: rows.join(ids.select("id"), "id"), sets, 0.8).collect()
        finally:
            neardup.GROUP_ROWS = was
        assert sorted((x.id, x.component) for x in got) == [(i, want[0]) for i in want]


def test_one_copy_of_a_passage_stays(spark):
    """The owner's copy, also after that of a greater id, and one of repeated rows in one block or two."""
    r = random.Random(12)
    passage = words(r, 60)
    for ids in ((5, 1), (5, 3, 1), (1, 1), (7, 1, 1, 5)):
        rows = [(i, f"{words(r, 30)} {passage} {words(r, 30)}") for i in ids]
        rows = [(i, next(t for j, t in rows if j == i)) for i in ids]
        for parts in (1, 2):
            df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
            got = chunk_dedup.repeated_spans(df).cache()
            middle = passage[200:260]
            left = [x.doc_id for x in chunk_dedup.remove_spans(df, got).collect() if middle in x.text]
            assert left == [1] and got.select("row").distinct().count() == len(ids) - 1


def test_common_runs_weigh_less(spark):
    """A passage of 5 % of all documents does not make short documents alike that share little else."""
    r = random.Random(21)
    common = words(r, 60)
    rows = [(i, f"{common} {words(r, 5)}" if i < 10 else words(r, 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((x.doc_id, x.class_id) for x in icws.near_duplicates(df, block_runs=3000).collect()), key=str)
    assert got == brute_classes(rows) and all(i == c for i, c in got) and got != brute_classes(rows, floor=0.1)


def test_short_items(spark):
    """Items of one to eight words, copied into texts of many and alone."""
    r = random.Random(14)
    items = [" ".join(f"w{n}x{k}" for k in range(n)) for n in range(1, 9)] + ["What is 2 + 2? 4"]
    texts = [f"{words(r, 40)} {x} {words(r, 40)}" for x in items] + items + [words(r, 80), "What is a 2"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(i, i % 9) for i in range(18)}
    assert {(x.doc_id, x.item_id) for x in decontam.find_contamination(d, b).collect()} == want
    assert {x.doc_id for x in decontam.drop_contaminated(d, b).collect()} == {18, 19}


def test_secrets_without_digits(spark):
    """Keys of letters alone are found; long words, identifiers and what is no secret's value aren't."""
    field = semicrf.Field().fit(semicrf.examples())
    r = random.Random(21)
    mixed = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(k))
    keys = ["AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(16)) for _ in range(40)] + ["sk_" + mixed(24) for _ in range(40)]
    clean = ["a geschwindigkeitsbegrenzung on the road", "the UserAccountManagerFactory is here", "the key: patience", "INTERNATIONALIZATION MATTERS", "password: required"]
    texts = [f"some words {k} then more" for k in keys] + [f'password = "{mixed(16)}" set' for _ in range(40)] + clean
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in semicrf.find_personal_data(d, field=field).collect()}
    found = [i for i in range(120) if "secret:" in got[i].spans]
    exact = [i for i in range(80) if got[i].spans == f"secret:11:{11 + len(keys[i])}"]
    assert len(found) >= 114 and len(exact) >= 76
    assert [got[i].n_spans for i in range(120, 125)] == [0] * 5


def test_spans_near_many_base_spans():
    """Time grows with the text, and nothing is added over a base span."""
    text = "mail a.b@c.org and 0123456789abcdef0123456789abcdef\n" * 3000
    base = semicrf.base_spans(text)
    added = semicrf.add_spans(text, base, semicrf.Field().fit(semicrf.examples(120)))
    taken = sorted([(s, e) for _, s, e in base] + [(s, e) for _, s, e in added])
    assert len(base) == 3000 and all(a[1] <= b[0] for a, b in zip(taken, taken[1:]))


def test_mix_of_named_ids(spark):
    """Ids that are no numbers: the same documents are taken in any order of rows."""
    rows = [(f"id{i}", "a b c d" if i % 2 else "a b " * (i % 7), ["x", "y", None][i % 3]) for i in range(300)]
    taken = []
    for k in (1, 2):
        d = spark.createDataFrame(rows[::k] + (rows[1::2] if k == 2 else []), "name string, text string, source string").repartition(3 * k)
        taken.append({x["name"]: x["_mix_copies"] for x in cube.mix_sources(d, id_col="name", block_rows=64).collect()})
    assert taken[0] == taken[1] and len(taken[0]) == 300


def test_workers_keep_one_operators_things():
    cache = X.process_cache()
    cache["encoder", "x"] = cache["other", "y"] = [0]
    b = pa.record_batch([pa.array(["a"])], ["text"])
    assert [x.num_rows for x in X.slices(iter([b]), keeps="encoder")] == [1]
    assert ("encoder", "x") in cache and ("other", "y") not in cache
    list(X.slices(iter([b])))
    assert ("encoder", "x") not in cache
