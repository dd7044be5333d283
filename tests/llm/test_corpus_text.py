"""Text operators against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tidewatch.llm import language, leaks, licenses, near, packing, passages, pii, tokens
from tidewatch.llm.common import Spans
from tidewatch.llm.queries import byte_vocabulary

SCHEMA = "doc_id long, text string, lang string, score string, bucket int, row int"
LONG = "lorem ipsum dolor " * 4000


def frame(spark, texts, lang="en"):
    """Documents with clashing extra columns; texts may be (id, text) pairs."""
    rows = [(*(t if isinstance(t, tuple) else (i, t)), lang, "x", 7, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


ODD = [None, "", " \n\t", "a", LONG, "same text here twice", "same text here twice", (5, "same text here twice"), (None, "no id"), "x\x00y ▁▁ é　<s> <|endoftext|>"]


# ---- passages -------------------------------------------------------------------


def brute_passages(docs, length):
    words = [(d, (t or "").encode().split()) for d, t in docs]
    first = {}
    for d, w in words:
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for p in range(len(w) - length + 1):
            if d is not None and first[tuple(w[p : p + length])] < d:
                gone |= set(range(p, p + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("length,seed", [(6, 1), (7, 2), (2, 3)])
def test_passages(spark, length, seed):
    r = random.Random(seed)
    pool = [" ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(3, 25))) for _ in range(6)]
    docs = [(i, "\n".join(r.choice([*pool, " ".join(r.choice("pqrstuv") for _ in range(r.randint(0, 12)))]) for _ in range(r.randint(0, 5)))) for i in range(60)]
    docs += [(3, docs[9][1]), (9, docs[9][1]), (70, None), (71, ""), (None, docs[9][1])]
    got = passages.remove_repeats(frame(spark, docs), length).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_passages(docs, length)


def test_passages_odd(spark):
    docs = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(ODD)]
    got = passages.remove_repeats(frame(spark, ODD), 50).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_passages(docs, 50)
    assert passages.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("length", [2, 3, 7, 50, 256])
def test_anchors_of_few_words(length):
    # what is left of a batch after its last full chunk may have any number of words; 30, 36 to 38 and 45 to 48 failed at 50
    word = [b"w%d" % i for i in range(2 * length + 2)]
    for n in range(len(word)):
        for sizes in ([n], [n // 2, n - n // 2]):
            texts = [word[: sizes[0]], word[sizes[0] : n]]
            _, first, last, text = passages.anchors(Spans(texts), length)
            starts = [(t, p) for t, a, z in zip(text, first, last) for p in range(a, z + 1)]
            edges = [0, len(texts[0])]
            assert starts == [(t, edges[t] + p) for t in (0, 1) for p in range(len(texts[t]) - length + 1)]


def test_passages_after_a_long_text(spark):
    # a batch of a full chunk and 37 words more
    docs = [(0, "lorem ipsum dolor " * 60_000), (1, " ".join(f"w{i}" for i in range(37)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = passages.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter((d, len(t.split()), 0, hashlib.sha256(" ".join(t.split()).encode()).hexdigest()) for d, t in docs)


# ---- near duplicates ------------------------------------------------------------


def bag(text):
    w = (text or "").lower().encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(docs):
    bags = {}
    for d, t in docs:
        if d is not None:
            bags.setdefault(d, []).append(bag(t))
    ids = sorted(bags)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j:
                for x in bags[i]:
                    for y in bags[j]:
                        both = sum((x & y).values())
                        if both and both / (sum(x.values()) + sum(y.values()) - both) >= 0.8:
                            a, b = sorted((root(i), root(j)))
                            parent[b] = a
    return {i: root(i) for i in ids}


def near_copies(r, n, words, edits):
    base = [f"w{r.randint(0, 400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        c = list(base)
        for _ in range(r.randint(0, edits)):
            c[r.randrange(words)] = f"e{r.randint(0, 10**9)}"
        out.append(" ".join(c))
    return out


def test_near_classes(spark):
    r = random.Random(5)
    docs = near_copies(r, 60, 200, 7) + near_copies(r, 12, 40, 1) + [" ".join(f"u{r.randint(0, 9999)}" for _ in range(60)) for _ in range(20)]
    docs += docs[:5] + [docs[2].upper(), "three word text", "three word text", "", None, "pad " * 300, "pad " * 302]
    r.shuffle(docs)
    pairs = list(enumerate(docs)) + [(3, docs[3]), (None, docs[3])]
    got = near.classes(frame(spark, pairs)).collect()
    want = brute_classes(pairs)
    assert len(got) == len(pairs)
    assert {x["doc_id"]: x["class_id"] for x in got if x["doc_id"] is not None} == want
    assert [x["class_id"] for x in got if x["doc_id"] is None] == [None]


def test_near_ids_with_several_texts(spark):
    """All texts of an id count, and an id links the classes of its texts; one row out for each row in."""
    r = random.Random(6)
    a, b, c, d = (" ".join(f"{k}{r.randint(0, 9999)}" for _ in range(60)) for k in "abcd")
    pairs = [(1, a), (2, b), (5, a), (5, b), (7, c)]
    got = sorted((x["doc_id"], x["class_id"]) for x in near.classes(frame(spark, pairs)).collect())
    assert got == [(1, 1), (2, 1), (5, 1), (5, 1), (7, 7)]
    # neither text of 8 has an exact copy; 9 is near to one of them and 3 to the other
    pairs = [(8, c), (8, d), (8, d), (9, c + " more"), (3, d + " more"), (4, a), (2**61, b), (2**61, a)]
    got = sorted((x["doc_id"], x["class_id"]) for x in near.classes(frame(spark, pairs)).collect())
    assert got == [(3, 3), (4, 4), (8, 3), (8, 3), (8, 3), (9, 3), (2**61, 4), (2**61, 4)]


def thue_morse(size):
    word = "a"
    while len(word) < size:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_that_break_weak_hashes(spark, size):
    """Long words for which every polynomial modulo a power of two has equal values."""
    one, other = thue_morse(size)
    rest = [f"w{i}" for i in range(49)]
    pairs = [(1, " ".join([one, *rest])), (2, " ".join([other, *rest]))]
    got = {x["doc_id"]: x["n_removed"] for x in passages.remove_repeats(frame(spark, pairs)).collect()}
    assert got == {1: 0, 2: 0}
    pairs = [(1, " ".join([one] * 30)), (2, " ".join([other] * 30))]
    assert {x["class_id"] for x in near.classes(frame(spark, pairs)).collect()} == {1, 2}


def test_near_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {x["doc_id"]: x["class_id"] for x in near.classes(rows).collect()}
    assert got == brute_classes([tuple(x) for x in rows.collect()])


def test_near_empty(spark):
    assert near.classes(frame(spark, [])).count() == 0
    got = near.classes(frame(spark, [None, "", "a b"])).collect()
    assert all(x["doc_id"] == x["class_id"] for x in got)


def test_prefix_filter_loses_nothing(spark):
    r = random.Random(8)
    docs = near_copies(r, 40, 60, 6)
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(docs)], "doc_id long, text string, class long")
    got = {(x["a"], x["b"]) for x in near.similar_prefixes(rows, 0.8).collect()}
    bags = [bag(t) for t in docs]
    for i in range(40):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both / (sum(bags[i].values()) + sum(bags[j].values()) - both) >= 0.8:
                assert (j, i) in got


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(3)
    for low, high in ((1, 2), (1, 9), (5, 60)):
        a = {int(k): int(c) for k, c in zip(rng.integers(0, 2**62, 50), rng.integers(low, high, 50))}
        b = {k: max(1, c + int(rng.integers(-2, 3))) for k, c in list(a.items())[:40]} | {int(k): 3 for k in rng.integers(0, 2**62, 8)}
        keys = [*a, *b]
        text = np.array([0] * len(a) + [1] * len(b))
        sig = near.bag_minhash(2, text, np.array(keys, dtype=np.uint64), np.array([*a.values(), *b.values()]), 8192)
        true = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
        assert abs((sig[0] == sig[1]).mean() - true) < 0.03


# ---- leaks ----------------------------------------------------------------------


def shingles(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute_leaks(docs, items):
    out = {}
    for d, t in docs:
        x = shingles(t)
        for j, item in items:
            y = shingles(item)
            if not x or not y or d is None:
                continue
            for p in range(max(1, len(x) - len(y) + 1)):
                w = Counter(x[p : p + len(y)])
                both = sum((w & Counter(y)).values())
                s = both / (sum(w.values()) + len(y) - both)
                if s >= 0.8:
                    out[d, j] = max(s, out.get((d, j), 0))
    return out


def test_leaks(spark):
    r = random.Random(4)
    items = [(i, " ".join(f"b{r.randint(0, 3000)}" for _ in range(r.randint(20, 60)))) for i in range(12)] + [(20, None), (21, "too short"), (22, "")]
    docs = []
    for i in range(60):
        words = [f"d{r.randint(0, 500)}" for _ in range(r.randint(0, 200))]
        if i % 3 == 0:
            leak = items[r.randrange(12)][1].split()
            if i % 6 == 0:
                leak[r.choice([0, 1, len(leak) - 1])] = "changed"
            at = r.randint(0, len(words))
            words[at:at] = [w.upper() + "," for w in leak]
        docs.append((i, " ".join(words)))
    docs += [(100, items[0][1]), (100, items[0][1]), (101, None), (102, ""), (None, items[0][1]), (103, LONG + items[1][1])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, start string")
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in leaks.contaminated(frame(spark, docs), bench).collect()}
    want = brute_leaks(docs, items)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert leaks.contaminated(frame(spark, []), bench).count() == 0
    assert leaks.contaminated(frame(spark, docs), bench.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_leaks_with_words_put_in_and_left_out(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(leaks, "BROADCAST_ANCHORS", 0)
    r = random.Random(14)
    items = [(i, " ".join(f"b{r.randint(0, 400)}" for _ in range(r.choice([12, 40, 60, 90, 120, 160])))) for i in range(10)]
    docs = []
    for i in range(150):
        leak = items[r.randrange(10)][1].split()
        for _ in range(r.randrange(1, 5)):
            at = r.randrange(len(leak))
            leak[at : at + r.choice([0, 1, 3])] = [f"n{r.randint(0, 9)}"] * r.choice([0, 1, 2, 6])
        before = [f"d{r.randint(0, 500)}" for _ in range(r.randint(0, 60))]
        docs.append((i, " ".join(before + leak + before[::-1])))
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in leaks.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_leaks(docs, items)
    assert len(want) > 40 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_fingerprint_of_very_many_shingles(spark):
    hashes = [-1] * 17_000 + [5] * 100 + [-1] * 16_000
    table = spark.createDataFrame([(1, hashes), (2, [5, 5, 1])], "item_id long, item array<long>")
    got = {x["item_id"]: x["fingerprint"] for x in leaks.fingerprints(table, ["item_id"], "item").collect()}
    assert got == {1: -1, 2: 5}


def test_blocks_find_every_fingerprint_within_radius(spark):
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(30)]

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    flips = [(i, b ^ sum(1 << p for p in r.sample(range(64), i))) for i, b in enumerate(base)]
    items = spark.createDataFrame([(i, 4, [i], signed(b)) for i, b in enumerate(base)], "item_id long, size int, item array<long>, fingerprint long")
    found = spark.createDataFrame([(i, 0, 4, [i], signed(b)) for i, b in flips], "doc_id long, start int, size int, window array<long>, fingerprint long")
    got = [(x["doc_id"], x["item_id"]) for x in leaks.candidates(found, items, 23).collect()]
    want = {(i, j) for i, x in flips for j, y in enumerate(base) if bin(x ^ y).count("1") <= 23}
    assert len(got) == len(set(got)) and set(got) == want


# ---- licenses -------------------------------------------------------------------


def test_licenses(spark):
    texts = [
        "Licensed under the Apache License,\nVersion 2.0. And MIT  License; mit license",
        "GNU GENERAL PUBLIC LICENSE version 3 or later",
        "cc by-nc-sa 4.0, submit license accby",
        *ODD,
    ]
    got = {i: x for i, x in enumerate(licenses.scan(frame(spark, [t if not isinstance(t, tuple) else t[1] for t in texts])).orderBy("doc_id").collect())}
    for i, t in enumerate(texts):
        t = (t[1] if isinstance(t, tuple) else t) or ""
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        places = [(p, label) for phrase, label in licenses.BASE.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        x = got[i]
        assert (x["n_words"], x["n_base"]) == (len(words), len(places))
        assert (x["first_word"], x["last_word"]) == (min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert x["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(x["base_labels"].split(",")) - {""} <= set(x["labels"].split(","))
        assert 0 <= x["score"] <= 1
    assert got[0]["labels"] == "apache,apache-2.0,mit" and got[1]["labels"] == "gpl,gpl-3-or-later"
    assert got[2]["labels"] == "cc-by,cc-by-nc-sa-4.0"
    assert licenses.scan(frame(spark, [])).count() == 0


def test_license_rules():
    assert len(licenses.rules()) >= 300
    compiled = [(r, re.compile(r.pattern)) for r in licenses.rules()]
    found = licenses.detections("released under the terms of the mit license", compiled)
    assert [(d[0], d[1], d[2].label) for d in found] == [(0, 43, "mit")]  # the inner detections are suppressed


# ---- tokens ---------------------------------------------------------------------


def test_token_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "the", "ing", "▁", "é", "　", "<s>", "0.5", "\x00", "Hello", "😀", "word"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(200)] + [x[1] if isinstance(x, tuple) else x for x in ODD]
    for head in (5, 1000):
        got = tokens.count_tokens(frame(spark, texts), tokens.read_model(path), limit=30, head=head).orderBy("doc_id").collect()
        want = [(i, len((t or "").encode()), len(pieces.encode(t or ""))) for i, t in enumerate(texts)]
        assert [(x["doc_id"], x["n_bytes"], x["n_tokens"], x["over_limit"]) for x in got] == [(*w, w[2] > 30) for w in want]
    assert tokens.count_tokens(frame(spark, []), tokens.read_model(path)).count() == 0


# ---- packing --------------------------------------------------------------------


def test_packing(spark):
    import zlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(9)
    texts = ["".join(r.choice(["the ", "x", "\n", "été ", "12", "<|endoftext|>", "  "]) for _ in range(r.randint(0, 900))) for _ in range(60)]
    texts += [x[1] if isinstance(x, tuple) else x for x in ODD] + [" " * 5000 + "a"]
    vocabulary, pattern = byte_vocabulary()
    got = packing.pack(frame(spark, texts), vocabulary, pattern).collect()
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for t in texts]
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for x in got:
        by_doc[x["doc_id"]].append(x)
        by_seq[x["sequence_id"]].append(x)
        part = ids[x["doc_id"]][x["start"] : x["start"] + x["length"]]
        assert (x["ids_crc32"], x["doc_tokens"]) == (zlib.crc32(part.tobytes()), len(ids[x["doc_id"]]))
    for d, own in enumerate(ids):
        at = 0
        for x in sorted(by_doc[d], key=lambda x: x["start"]):
            assert x["start"] == at
            at += x["length"]
        assert at == len(own)
    used = padded = 0
    for xs in by_seq.values():
        at = 0
        for x in sorted(xs, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= 1024
        used += at
        padded += at if at & (at - 1) == 0 else 1024
    assert padded - used < 1024 + 0.05 * used
    assert packing.pack(frame(spark, []), vocabulary, pattern).count() == 0


def test_plan_places_every_length():
    r = random.Random(3)
    for _ in range(30):
        histogram = Counter(r.randint(1, 1024) for _ in range(r.randint(0, 400)))
        plan = packing.plan_windows(dict(histogram))
        back = Counter()
        for p in plan:
            assert sum(p.lengths) <= p.tier
            for size in p.lengths:
                back[size] += p.times
        assert back == histogram


# ---- personal data --------------------------------------------------------------


def naive_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_base_spans():
    r = random.Random(1)
    parts = ["1", "2.", "@", "a", "b.c", "-", " ", "+", "(", "4", "é", "255", "4111111111111111", ".", "\n", "+1 555", "0007."]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 25)))
        assert pii.base_spans(text) == naive_spans(text), text


def test_personal_data(spark):
    texts = ["mail a.b@c.example.org now", "call +1 (377) 555-7713 or 10.0.0.255", "card 4111 1111 1111 1111, 4111111111111112", *[x[1] if isinstance(x, tuple) else x for x in ODD]]
    texts += [f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and {i}@mail{i}.example.com' for i in range(30)]
    got = pii.find(frame(spark, texts)).orderBy("doc_id").collect()
    for t, x in zip(texts, got):
        base = naive_spans(t or "")
        assert [x[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in base) for k in pii.BASE_KINDS]
        assert x["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert {f"{k}:{a}:{z}" for k, a, z in base} <= set(x["spans"].split(","))
    assert sum("secret" in x["spans"] for x in got) >= 25
    assert pii.redact_text("mail a.b@c.example.org now", got[0]["spans"]) == "mail <EMAIL> now"
    assert pii.find(frame(spark, [])).count() == 0


def test_twins_pull_each_other():
    n = len(pii.KINDS) + 1
    weights = np.zeros((1 << pii.BITS, n))
    weights[1, 0], weights[2, pii.OTHER] = 4.0, 0.3
    skip = np.full((n, n), 0.2) + 3 * np.eye(n)
    field = pii.Field(weights, np.ones((n, n)), skip)
    alone = field.marginals(np.array([[1], [2]]), np.array([1, 1]), np.zeros((0, 2), dtype=int))
    linked = field.marginals(np.array([[1], [2]]), np.array([1, 1]), np.array([[0, 1]]))
    assert alone[1].argmax() == pii.OTHER and linked[1].argmax() == 0


# ---- language -------------------------------------------------------------------


def test_forward_backward():
    rng = np.random.default_rng(2)
    emit, trans, start = rng.random((9, 3)) + 0.1, rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    got = language.forward_backward(emit, trans, start, np.array([4, 2, 3]))
    import itertools

    at = 0
    for size in (4, 2, 3):
        want = np.zeros((size, 3))
        for path in itertools.product(range(3), repeat=size):
            p = start[path[0]] * np.prod([trans[a, b] for a, b in zip(path, path[1:])]) * np.prod([emit[at + i, y] for i, y in enumerate(path)])
            for i, y in enumerate(path):
                want[i, y] += p
        assert np.allclose(got[at : at + size], want / want.sum(axis=1, keepdims=True))
        at += size


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 150 and sum(x["lang"] == x["lang_pred"] for x in rows) / len(rows) > 0.97
    assert all(0 <= x["score"] <= 1 for x in rows)


def test_language_odd(spark):
    texts = [*ODD, "123 ²³ !!", *(["the cat and dog sat"] * 10), *(["der hund und die katze"] * 10)]
    rows = [(*(t if isinstance(t, tuple) else (i, t)), None if i < 12 else "en" if "the" in (t or "") else "de", "x", 1, 1) for i, t in enumerate(texts)]
    got = language.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for x, row in zip(sorted(got, key=lambda x: (x["doc_id"] is None, x["doc_id"])), sorted(rows, key=lambda x: (x[0] is None, x[0]))):
        assert (x["lang_pred"] == "und") == (not any(c.isalpha() for c in row[1] or ""))
    assert language.identify(frame(spark, [])).count() == 0
    nothing = language.identify(frame(spark, ["a b", "c"], lang=None)).collect()
    assert [x["lang_pred"] for x in nothing] == ["und", "und"]


def test_language_of_long_texts_is_learned(spark):
    """A language found only in texts over the bound is learned from stretches of them."""
    long = "1234567 " * 5000 + "der hund und die katze " * 1500
    rows = [(i, long if i % 2 else "the cat and dog sat", "de" if i % 2 else "en", "x", 1, 1) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    cut = language.training_texts(docs, 2000, 20_000).collect()
    assert {x["lang"] for x in cut} == {"de", "en"} and all(len(x["text"]) <= 20_000 for x in cut)
    assert len({x["text"] for x in cut if x["lang"] == "de"}) > 1
    got = language.identify(docs).collect()
    assert all(x["lang_pred"] == ("de" if x["doc_id"] % 2 else "en") for x in got)
