"""The corpus operators against plain versions of what they compute, and their results for unusual tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from mediaspark.llm import common, decontaminate, exact_dedup, graph, language_id, licenses, near_dedup, packing, pii, registry, substring_dedup, suffix_dedup, toxicity
from oracle import oracle, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
OPERATORS = {
    "licenses": lambda d: licenses.scan(d, licenses.fit(*licenses.examples(["some plain words of a text"] * 20))),
    "pii": lambda d: pii.scan(d),
    "language": lambda d: language_id.predict(d, None),
    "exact": exact_dedup.groups,
    "substring": substring_dedup.dedup,
    "packing": packing.pack,
    "toxicity": lambda d: toxicity.score(d, None),
    "near": near_dedup.link,
    "suffix": suffix_dedup.passages,
    "benchmark": lambda d: decontaminate.contained(d, d.sparkSession.createDataFrame([(1, "a b c d e f g"), (None, None), (3, "")], "item_id long, text string")),
}


def made(seed=1, n=150):
    """Documents with copies, near copies, shared passages, repeats, empty and very long texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passages = [text(60) for _ in range(4)]
    out = [text(rng.choice([0, 1, 2, 19, 20, 21, 60, 200])) for _ in range(n)]
    for _ in range(n // 3):
        out[rng.randrange(n)] = rng.choice(out)
    for _ in range(n // 3):
        w = rng.choice(out).split(" ")
        if len(w) > 50:
            w[rng.randrange(len(w))] = "changed"
            out[rng.randrange(n)] = " ".join(w)
    for _ in range(n // 4):
        k = rng.randrange(n)
        out[k] = out[k] + "\n" + rng.choice(passages) + "\t" + text(5)
    out[3] = passages[0] + " " + passages[0]
    out[4] = "same word " * 300
    out[5] = text(30_000)
    out[6] = None
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_unusual_tables(spark, name):
    """Nulls in every column, repeated rows, ties, extra columns with clashing names, an empty table."""
    rows = [(1, "a b c d e f g", None, None, None), (1, "a b c d e f g", None, None, None), (None, None, None, None, None), (None, "x", "de", "s", 1), (2, "", "en", None, 0),
            (3, "\x00 é\n\n \t", "fr", "s", 5), (4, "word " * 2000, "en", "s", 1), (5, "z" * 20_000, "en", "s", 1)]
    extra = ", kept boolean, score double, spans string, `n words` int, _hot string, id long, root long"
    table = spark.createDataFrame([r + (None,) * 7 for r in rows], DOCS + extra)
    out = OPERATORS[name](table).collect()
    if name not in ("suffix", "benchmark"):
        assert len({r["doc_id"] for r in out}) == 6
    assert OPERATORS[name](spark.createDataFrame([], DOCS + extra)).collect() == []


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_queries_equal_sql(spark, sf_dir, name):
    assert same(registry.QUERIES[name](spark, sf_dir), *oracle(registry.ORACLE[name], sf_dir))


def test_exact_dedup(docs, rows):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.groups(docs).collect()} == want


def test_chunks_join_to_the_text():
    data = np.frombuffer(random.Random(2).randbytes(100_000) + b"a" * 200_000, np.uint8)
    off = np.array([0, 0, 10, 50_000, len(data)])
    for (a, b), ends in zip(zip(off, off[1:]), exact_dedup.cuts(data, off)):
        assert ends == sorted(set(ends)) and (ends[-1:] == [b] if b > a else ends == [])
        assert all(y - x <= exact_dedup.LONGEST for x, y in zip([a, *ends], ends))


def test_substring_dedup(docs, rows):
    seen, want = set(), {}
    for i, t, *_ in rows:
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s:s + 20])
            if key in seen:
                gone[s:s + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.dedup(docs).collect()} == want


@pytest.mark.parametrize("k, num", [(3, 85), (5, 80)])
def test_near_dedup(docs, rows, k, num):
    sets = {}
    for i, t, *_ in rows:
        w = WORDS.findall((t or "").lower())
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dedup.link(docs, near_dedup.Limit(k, num, 100)).collect()}
    assert got == {i: (len(s), find(i), i == find(i)) for i, s in sets.items()}


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 200), (300, 200), (5, 5)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {200: 100, 300: 100}


def stretches_by_brute_force(texts):
    """(document, start, words) of the stretches of words in windows of 50 that occur again, and the places of each window."""
    words = {i: WORDS.findall(t or "") for i, t in texts}
    places = collections.defaultdict(list)
    for i, w in words.items():
        for s in range(len(w) - 49):
            places[tuple(w[s:s + 50])].append((i, s))
    covered = collections.defaultdict(set)
    for own in places.values():
        for i, s in own if len(own) > 1 else []:
            covered[i].update(range(s, s + 50))
    out = set()
    for i, c in covered.items():
        for s in c:
            if s - 1 not in c:
                n = 1
                while s + n in c:
                    n += 1
                out.add((i, s, n))
    return out, words


def passages_are_right(spark, texts):
    want, words = stretches_by_brute_force(texts)
    got = suffix_dedup.passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["start"], r["n_words"]) for r in got} == want
    for r in got:
        assert (r["doc_id"], r["start"]) != (r["other_id"], r["other_start"])
        assert words[r["doc_id"]][r["start"]:r["start"] + 50] == words[r["other_id"]][r["other_start"]:r["other_start"] + 50]


def test_suffix_passages(spark, rows):
    passages_are_right(spark, [(i, t) for i, t, *_ in rows])


def test_suffix_passages_under_a_shared_header(spark):
    """Documents that all begin with one header of 40 words, and share 20 words with one other before or after it."""
    rng = random.Random(11)
    text = lambda k: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(k))
    header, docs = text(40), []
    for _ in range(60):
        own = text(20)
        docs += [f"{header} {own} {text(30)}", f"{header} {own} {text(30)}"]
    for _ in range(60):
        own = text(20)
        docs += [f"{text(5)} {own} {header} {text(30)}", f"{text(7)} {own} {header} {text(30)}"]
    rng.shuffle(docs)
    passages_are_right(spark, list(enumerate(docs)))


def ids_of(enc, texts):
    ids, off = enc.encode(*common.text_buffer(pa.array(texts, pa.string())))
    return [ids[i:j].tolist() for i, j in zip(off, off[1:])]


def test_packing(docs, rows):
    enc = packing.Encoder(packing.default_tokenizer())
    ids = {i: enc.direct(t or "") + [2] for i, t, *_ in rows}
    out = [r.asDict() for r in packing.pack(docs).collect()]
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, own in pieces.items():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own))) and sum(n for _, _, n in own) == len(ids[i])
        assert all(n == 1024 for _, _, n in own[1:]) and all(b == a + n for (_, a, n), (_, b, _) in zip(own, own[1:]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-sum(map(len, ids.values())) // 1024) * 1.02 + 1


def test_encoder_equals_tokenizer():
    enc = packing.Encoder(packing.default_tokenizer())
    for t in ["", " ", "a  b", "x\n\ny", "x \ny", "don't stop", "é　x  y", "<|endoftext|> hi", "a\x1cb c", "foo.\tbar, baz", "1.5 2,000 x.", "a.\nb", "...", "日本 語", "\na", "a,\n b"]:
        assert ids_of(enc, [t]) == [enc.direct(t)]


def test_encoder_on_odd_texts():
    rng = random.Random(12)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "b", "é", "the", "don't", "'s", "Word", "1", "23", ".", ",", "...", "!", "\u00a0", "\u2003", "\u3000", "…", "—", "«", "中文", "😀", "<|endoftext|>", "\x1c", "\x85", "|", "E.", "x,y", "?", "ß", "ʼ", "\r\n", "\x00", "²", "Ⅷ", "ﬁ", "×", "ɐ", "%%%", "a" * 40]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(8000)]
    enc = packing.Encoder(packing.default_tokenizer())
    for lo in range(0, 8000, 1000):
        assert ids_of(enc, texts[lo:lo + 1000]) == [enc.direct(t) for t in texts[lo:lo + 1000]]


def test_equal_pieces_survive_equal_hashes():
    """Pieces are grouped by their bytes; many short ones of like content stay apart."""
    data = np.frombuffer(b"ab\x00abab\x00\x00" * 50, np.uint8)
    starts, size = np.arange(0, 300, 3), np.tile([1, 2, 3, 3], 25)
    first, kind = packing.equal_pieces(data, starts, size)
    pieces = [bytes(data[s:s + n]) for s, n in zip(starts, size)]
    assert [pieces[first[k]] for k in kind] == pieces and len(first) == len(set(pieces))


def test_packing_plan_holds_each_piece():
    rng = np.random.default_rng(3)
    need = np.bincount(np.minimum(1024, rng.lognormal(6, 1, 20_000).astype(int) + 1), minlength=1025)
    got = np.zeros(1025, int)
    for times, lengths in packing.plan(need):
        assert sum(lengths) <= 1024
        for n in lengths:
            got[n] += times
    assert (got == need).all()


def test_decontamination(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 3, 5, 6, 12, 40, 200])]
    long = " ".join(word() for _ in range(3000))
    docs = [(100 + k, f"{long} {t.upper().replace(' ', ', ')}. {long}") for k, t in items]
    w = items[5][1].split(" ")
    w[20] = "other"
    docs += [(200, long), (201, long + " " + " ".join(w)), (202, None)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(100 + k, k) for k, _ in items} | {(201, 5)}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def fits(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    return [(m.start(), k, m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if fits(k, m.group())]


def test_base_spans():
    rng = random.Random(4)
    pieces = ["a@b.c", "@", ".", "x.y@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-1234", "+", "12", " ", "-", "a", "@b-c.d.e", "000255.1.2.3", "\n", "é"]
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(t) == sorted(plain_spans(t), key=lambda s: (s[0], list(BASE).index(s[1]), s[2]))
    assert pii.base_spans("7" * 300_000) == [] and pii.base_spans("a" * 300_000 + "@") == []


def test_added_spans():
    model = pii.train()
    texts = ["call (212) 555-0187 today please", "write to jane [at] mail [dot] com soon", "order no. 212 555 0187 shipped", "version 1.2.3 and nothing else", "plain words only"]
    more = pii.added_spans(texts, [pii.base_spans(t) for t in texts], model)
    assert [[s[1] for s in m] for m in more] == [["phone"], ["email"], [], [], []]
    assert pii.redact(texts[0], more[0]) == "call [phone] today please"


def test_language_is_learned():
    rng = random.Random(6)
    make = lambda alphabet: " ".join("".join(rng.choice(alphabet) for _ in range(5)) for _ in range(30)).encode()
    kinds = {"aa": "abcdefg", "bb": "hijklmé", "cc": "nopqrst"}
    texts, labels = zip(*[(make(a), k) for k, a in kinds.items() for _ in range(80)])
    model = language_id.fit(list(texts), list(labels))
    fresh = [(make(a).decode(), k) for k, a in kinds.items() for _ in range(20)]
    told, score = language_id.label(pa.array([t for t, _ in fresh] + [None, "", "123 !"]), model)
    assert np.mean([x == k for x, (_, k) in zip(told, fresh)]) > 0.95
    assert told[-3:] == ["und"] * 3 and ((score >= 0) & (score <= 1)).all()


def test_windows_cover_every_byte():
    data, off = np.frombuffer(bytes(range(97, 123)) * 60, np.uint8), np.array([0, 5, 5, 300, 1560])
    _, doc, size = language_id.windows(data, off)
    assert np.bincount(doc, size, 4).tolist() == [5, 0, 295, 1260]


def test_toxicity_is_learned():
    rng = random.Random(7)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    make = lambda bad: " ".join([rng.choice(plain) for _ in range(40)] + [f"vile{rng.choice('xyz')}{rng.choice(plain)}"] * bad)
    labels = np.array([k % 4 == 0 for k in range(600)], float)
    docs = []
    for y in labels:
        whole, stem, _ = toxicity.features(pa.array([make(int(y))]))
        docs.append((whole, stem))
    model = toxicity.fit(docs, labels, ["en"] * len(docs))
    fresh = pa.array([make(k % 2) for k in range(100)] + ["", None])
    s = toxicity.scores(model, *toxicity.features(fresh))
    assert ((s[:100] >= toxicity.CUT) == (np.arange(100) % 2 == 1)).mean() > 0.9
    assert ((s >= 0) & (s <= 1)).all() and (s[100:] < toxicity.CUT).all()


def test_licences():
    model = licenses.fit(*licenses.examples(["the cat sat on the mat by the door"] * 200))
    texts = ["Intro line\nReleased under the MIT License.\nmore", "Licensed under the Apache License, Version 2.0.", "She renewed her driver's license last week.", "nothing here", "", None,
             "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."]
    got = [[x[2] for x in g] for g in licenses.find(pa.array(texts), model)]
    assert got == [["mit"], ["apache"], [], [], [], [], ["gpl"], ["cc-by-nc"]]


def test_hot_keys_join_once(spark):
    big = spark.createDataFrame([(k, "hot" if k % 2 else None if k % 10 == 0 else f"k{k}") for k in range(4000)], "id long, key string")
    small = big.groupBy("key").count().withColumnRenamed("count", "n")
    got = {r["id"]: r["n"] for r in common.hot_join(big, small, "key", "n", 4000).collect()}
    assert len(got) == 4000 and got[1] == 2000 and got[2] == 1 and got[10] is None


def test_near_dedup_star(spark):
    """A base and many edited copies, each linked with the base alone (0.86; two copies have 0.74): no link may go."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(404)]
    docs = [(5000, " ".join(base))]
    for i in range(2000):
        w = list(base)
        for p in rng.sample(range(10, 390, 6), 6):
            w[p] = f"c{i}x{p}"
        docs.append((i if i < 1000 else i + 9000, " ".join(w)))
    got = near_dedup.link(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == 2001 and {r["component_id"] for r in got} == {0}
    assert [r["doc_id"] for r in got if r["kept"]] == [0]


def test_suffix_passages_with_a_frequent_line(spark):
    """A line of 30 words that hundreds of texts have, in the midst of passages that two share."""
    rng = random.Random(10)
    text = lambda k: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(k))
    line = text(30)
    docs = [f"{text(12)} {line} {text(12)}" for _ in range(400)]
    for k in range(20):
        passage = f"{text(10)} {line} {text(10)}"
        docs[7 * k] = f"{text(9)} {passage} {text(3)}"
        docs[399 - 7 * k] = f"{text(2)} {passage} {text(8)}"
    passages_are_right(spark, list(enumerate(docs)))


def test_encoder_takes_any_number_of_lines():
    enc = packing.Encoder(packing.default_tokenizer())
    for t in ["\n".join(f"word{k}" for k in range(5000)), "a\n" * 3000, "x y\n" + "\n".join("ab" for _ in range(3000)) + "\n\nz\nq, r"]:
        assert ids_of(enc, [t]) == [enc.direct(t)]


def test_wrapped_licences():
    """Notices over several lines, with comment marks; a blank line ends one, and lines around it stay out."""
    model = licenses.fit(*licenses.examples(["the cat sat on the mat by the door"] * 200))
    mit = ["# Permission is hereby granted, free of charge, to any person obtaining a copy", "# of this software and associated documentation files (the \"Software\"), to deal", "# in the Software without restriction."]
    bsd = [" * Redistribution and use in source and binary forms, with or without", " * modification, are permitted provided that the following conditions are met:"]
    texts = ["\n".join(mit), "/*\n" + "\n".join(bsd) + "\n */\nint main() {}", "\n\n".join(bsd[:1] + ["x"] + bsd[1:]), "He is a licensed engineer\nin the state of things\nand no more", "\n".join(mit + ["#"] + bsd)]
    got = licenses.find(pa.array(texts), model)
    assert [[x[2] for x in g] for g in got] == [["mit"], ["bsd"], [], [], ["mit", "bsd"]]
    assert got[0][0][:2] == (0, len(texts[0])) and got[1][0][:2] == (3, 3 + len("\n".join(bsd)) + 1)


def components_by_brute_force(texts, k, num):
    sets = {i: {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if (w := WORDS.findall(t.lower())) else set() for i, t in texts}
    code = {x: n for n, x in enumerate(sorted(set().union(*sets.values())))}
    has = np.zeros((len(sets), len(code)), np.float32)
    ids = sorted(sets)
    for r, i in enumerate(ids):
        has[r, [code[x] for x in sets[i]]] = 1
    both, size = has @ has.T, has.sum(1)
    links = np.argwhere(np.triu(100 * both >= num * (size[:, None] + size[None] - both), 1) & (both > 0))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(ids[a]), find(ids[b])
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, len(links)


@pytest.mark.parametrize("swapped", [14, 11])
def test_near_dedup_crowd(spark, monkeypatch, swapped):
    """A crowd of variants of one text that are below the limit to each other, with linked pairs inside: no link may go."""
    monkeypatch.setattr(near_dedup, "CROWD", 64)
    monkeypatch.setattr(near_dedup, "SLICE", 128)
    rng = random.Random(swapped)
    base, docs = [f"w{k}" for k in range(402)], []
    for i in range(500):
        w = list(base)
        for p in rng.sample(range(5, 395, 6), swapped):
            w[p] = f"c{i}x{p}"
        near = list(w)
        for p in rng.sample(range(5, 395, 6), 3):
            near[p] = f"d{i}x{p}"
        docs += [" ".join(w), " ".join(near)]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    want, n = components_by_brute_force(docs, 3, 85)
    assert 500 <= n
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.link(spark.createDataFrame(docs, "doc_id long, text string"), near_dedup.Limit(3, 85, 100)).collect()}
    assert got == want


def test_near_dedup_with_repeated_ids(spark):
    rows = [(9, "a b c d e f g h"), (9, "q r s t u v w x y"), (3, "q r s t u v w x y z1"), (None, "a b c d e f g h"), (None, "own words alone here now"), (4, None)]
    got = near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string"), near_dedup.Limit(3, 85, 100)).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [(0, 3, 0), (0, 6, 9), (3, 8, 3), (4, 0, 4), (9, 6, 9), (9, 7, 3)]


def test_bitmaps_never_differ_more_than_the_sets():
    rng = np.random.default_rng(13)
    a = pa.array([" ".join(f"w{k}" for k in rng.integers(0, 300, 400)) for _ in range(40)])
    values, off, _ = common.shingle_sets(a, 1)
    sets = [set(values[i:j].tolist()) for i, j in zip(off, off[1:])]
    bits = np.zeros((40, near_dedup.BITS), np.uint8)
    for r, s in enumerate(sets):
        for v in s:
            bits[r, v >> 53] ^= 1
    packed = np.packbits(bits, axis=1).view(np.uint64)
    i, j = np.triu_indices(40, 1)
    assert (near_dedup._differ(packed, i, j) <= [len(sets[x] ^ sets[y]) for x, y in zip(i, j)]).all()


def test_every_family_is_found():
    """Each notice, alone in a line, wrapped and with comment marks."""
    model = licenses.fit(*licenses.examples(["the cat sat on the mat by the door"] * 200))
    want, texts = [], []
    for family, notices in licenses.TEMPLATES.items():
        for notice in notices:
            w = notice.split()
            texts += [f"Some text.\n{notice}\nMore text.", "\n".join("// " + " ".join(w[k:k + 9]) for k in range(0, len(w), 9))]
            want += [family] * 2
    got = [{x[2] for x in g} for g in licenses.find(pa.array(texts), model)]
    found = [w in g for w, g in zip(want, got)]
    assert np.mean(found) >= 0.97, [(w, g, t) for w, g, t, f in zip(want, got, texts, found) if not f]


def test_overlaps_are_swept():
    """The spans that are added to a long text don't overlap, and the time grows as its length."""
    model = pii.train()
    text = "call (212) 555-0187 or 212.555.0188 and jane [at] mail [dot] com, a@b.example +1 (212) 555-0189; " * 3000
    base = pii.base_spans(text)
    more = pii.added_spans([text], [base], model)[0]
    every = sorted(base + more)
    assert len(more) >= 3000 and all(m[0] >= b[2] or b[0] >= m[2] for m, b in zip(every, every[1:]) if m in more or b in more)


def test_tidy_keeps_what_a_function_gives_and_its_errors():
    from mediaspark.llm.common import tidy

    @tidy
    def run(batches):
        for b in batches:
            if b < 0:
                raise ValueError("negative")
            yield b + 1

    assert list(run(iter([1, 2, 3]))) == [2, 3, 4] and run.__name__ == "run"
    assert next(run(iter([1, 2]))) == 2  # closed early
    with pytest.raises(ValueError, match="negative"):
        list(run(iter([1, -1])))


ODD = [(1, "a b c d e f g", None, None, None), (1, "a b c d e f g", None, None, None), (None, None, None, None, None), (None, "x", "de", "s", 1), (2, "", "en", None, 0),
       (3, "\x00 é\n\n \t", "fr", "s", 5), (4, "word " * 2000, "en", "s", 1), (5, "z" * 20_000, "en", "s", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeated rows, empty and long texts, and columns that operators use themselves."""
    return spark.createDataFrame([r + (None,) * 4 for r in ODD], DOCS + ", kept boolean, score double, lang_pred string, doc long")


def by_text(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


def test_values_of_an_odd_table(odd):
    e = hashlib.sha256(b"").hexdigest()
    exact = [tuple(r)[:4] for r in exact_dedup.groups(odd).collect()]
    assert by_text(exact) == by_text([(1, 1, 2, True)] * 2 + [(None, 2, 2, False), (2, 2, 2, True), (None, None, 1, True), (3, 3, 1, True), (4, 4, 1, True), (5, 5, 1, True)])
    words = [tuple(r)[:3] for r in substring_dedup.dedup(odd).collect()]
    assert by_text(words) == by_text([(1, 7, 0)] * 2 + [(None, 0, 0), (None, 1, 0), (2, 0, 0), (3, 2, 0), (4, 2000, 1999), (5, 1, 0)])
    near = [tuple(r) for r in near_dedup.link(odd, near_dedup.Limit(3, 85, 100)).collect()]
    assert by_text(near) == by_text([(1, 5, 1, True)] * 2 + [(None, 0, None, True), (None, 1, None, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 4, True), (5, 1, 5, True)])
    assert [tuple(r)[:4] for r in suffix_dedup.passages(odd).collect()] == [(4, 0, 2000, 4)]
    spans = pii.scan(odd).collect()
    assert len(spans) == 8 and all(tuple(r)[1:] == (0, 0, 0, 0, e, "") for r in spans)
    model = licenses.fit(*licenses.examples(["some plain words of a text"] * 20))
    found = licenses.scan(odd, model).collect()
    assert len(found) == 8 and all((r["n_licensed"], r["families"], r["spans"], r["score"]) == (0, "", "", 0.0) for r in found)
    benchmark = odd.sparkSession.createDataFrame([(1, "a b c d e f g"), (None, None), (3, "")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(odd, benchmark).collect()} == {(1, 1)}
    enc = packing.Encoder(packing.default_tokenizer())
    want = collections.Counter()
    for i, t, *_ in ODD:
        want[i] += len(enc.direct(t or "")) + 1
    assert {r["doc_id"]: r["n"] for r in packing.pack(odd).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()} == dict(want)


def test_trained_models_on_an_odd_table(spark, odd):
    net = language_id.fit([b"some plain english words", b"quelques mots de plus \xc3\xa9"] * 40, ["en", "fr"] * 40)
    told = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in language_id.predict(odd, net).collect()}
    assert len(told) == 7 and all((p == "und") == (not t) and 0 <= s <= 1 for (_, t), (p, s) in told.items())
    assert language_id.predict(odd.limit(0), net).collect() == []
    docs = [tuple(x for x in toxicity.features(pa.array([t]))[:2]) for t in ["good plain text of words", "vile words of a vile kind"] * 60]
    model = toxicity.fit(docs, np.array([0.0, 1.0] * 60), ["en"] * 120)
    got = toxicity.score(odd, model).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= toxicity.CUT) for r in got)
    assert [r["score"] for r in got if not r["text"]] == [0.0, 0.0]
    assert toxicity.score(odd.limit(0), model).collect() == []


def test_learned_from_documents(spark, sf_dir):
    """Language and toxicity of rows that were not learned from, with the labels of the tables."""
    sf = sf_dir.replace("sf0.001", "sf0.01")
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    own = registry.QUERIES["op3_language_id"](spark, sf).filter("held_out").join(rows, "doc_id").filter("lang IS NOT NULL AND lang_pred <> 'und'")
    assert own.selectExpr("avg(CAST(lang = lang_pred AS INT))").first()[0] >= 0.97
    sf = sf_dir.replace("sf0.001", "sf0.1")  # sf0.01 has 37 toxic rows to learn from, with which the area is 0.74
    marks = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = [tuple(r) for r in registry.QUERIES["op8_toxicity"](spark, sf).filter("held_out").join(marks, "doc_id").select("score", "toxic").collect()]
    bad, good = (np.array([s for s, y in got if y == k]) for k in (1, 0))
    area = np.mean((bad[:, None] > good[None]) + 0.5 * (bad[:, None] == good[None]))
    assert len(bad) >= 100 and area >= 0.95


SHARED = [" ".join(f"{c}{k}" for k in range(70)) for c in "uvwxy"]
SHARED_ROWS = [(1, SHARED[0]), (7, SHARED[0] + " tail a"), (7, SHARED[1] + " b"), (7, "short one"), (9, SHARED[1] + " c " + SHARED[0]), (None, SHARED[2]), (None, SHARED[3] + " " + SHARED[2]),
               (8, SHARED[3]), (8, SHARED[3]), (None, None), (3, SHARED[4]), (3, "q " + SHARED[4]), (6, None)]


def in_order(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{'-' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest())
    return sorted(set(rows), key=key)


def test_substring_dedup_of_shared_ids(spark):
    """Rows that share a doc_id, or have none, are documents of their own; equal ones get equal results."""
    seen, want = set(), {}
    for i, t in in_order(SHARED_ROWS):
        w = (t or "").split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if tuple(w[s:s + 20]) in seen:
                gone[s:s + 20] = [True] * 20
            seen.add(tuple(w[s:s + 20]))
        want[i, t] = (i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    got = [tuple(r) for r in substring_dedup.dedup(spark.createDataFrame(SHARED_ROWS, "doc_id long, text string")).collect()]
    assert by_text(got) == by_text([want[r] for r in SHARED_ROWS])


def test_suffix_passages_of_shared_ids(spark):
    rows = in_order(SHARED_ROWS)
    stretches, _ = stretches_by_brute_force([(k, t) for k, (_, t) in enumerate(rows)])
    got = suffix_dedup.passages(spark.createDataFrame(SHARED_ROWS, "doc_id long, text string")).collect()
    assert by_text([(r["doc_id"], r["start"], r["n_words"]) for r in got]) == by_text([(rows[k][0], s, n) for k, s, n in stretches])
