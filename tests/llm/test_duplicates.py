import hashlib
import itertools
import pathlib
import random
import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])

import data  # noqa: E402
from sparkprep.llm import graph, order_minhash, spotsigs  # noqa: E402
from sparkprep.llm.common import WORDS  # noqa: E402
from sparkprep.session import Scratch, shared_folder  # noqa: E402


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_banded_alignment():
    rng = random.Random(1)
    for _ in range(1500):
        a = [rng.randrange(4) for _ in range(rng.randrange(25))]
        b = list(a)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(4)] * rng.randrange(2)
        want = distance(a, b)
        assert order_minhash.within(a, b, want) and order_minhash.within(b, a, want + 3)
        assert not want or not order_minhash.within(a, b, want - 1)
        assert order_minhash.similar(a, b) == (want <= int(0.2 * max(len(a), len(b)) + 1e-9))


def near_texts(seed=4, groups=12, copies=6):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        words = data.prose(rng, "en", rng.randrange(40, 160)).split()
        texts.append(" ".join(words))
        for _ in range(copies):
            own = list(words)
            for _ in range(rng.randrange(1, 1 + max(2, len(own) // 40))):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    return texts


def test_classes_equal_brute_force(spark):
    rng = random.Random(9)
    passage = data.prose(rng, "de", 60)
    texts = near_texts() + [data.prose(rng, "fr", 80) + " " + passage for _ in range(40)]
    texts += [texts[0]] * 30 + ["one two", "one two", "one  two", "three"]
    got = order_minhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = {r.doc_id: r.class_id for r in got.collect()}
    words = [WORDS.findall(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        longer = max(len(words[i]), len(words[j]))
        enough = longer >= 5 and abs(len(words[i]) - len(words[j])) <= 0.2 * longer
        if texts[i] == texts[j] or (enough and root(i) != root(j) and distance(words[i], words[j]) <= int(0.2 * longer + 1e-9)):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    assert found == {i: root(i) for i in range(len(texts))}


def test_scattered_changes_and_short_texts_meet(spark):
    rng = random.Random(12)
    pairs = []
    for _ in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        own = list(words)
        for at in rng.sample(range(200), 40):
            own[at] = f"n{rng.randrange(10**6)}"
        pairs.append((words, own))
    for n in range(5, 20):
        words = [f"s{n}x{i}" for i in range(n)]
        edits = int(0.2 * n)
        own = [f"t{n}" if (i + 1) % (n // (edits + 1) + 1) == 0 else w for i, w in enumerate(words)]
        pairs.append((words, own))
        # one word more in the middle, where the rule allows it
        words = [f"u{n}x{i}" for i in range(n)]
        pairs.append((words, [*words[: n // 2], f"v{n}", *words[n // 2 :]]))
    want = sum(order_minhash.similar(a, b) for a, b in pairs)
    assert want >= 60 + 15
    rows = [(2 * i + k, " ".join(text)) for i, pair in enumerate(pairs) for k, text in enumerate(pair)]
    found = {r.doc_id: r.class_id for r in order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    met = [found[2 * i] == found[2 * i + 1] for i in range(len(pairs))]
    assert sum(met[:60]) >= 58
    assert met[60:] == [order_minhash.similar(a, b) for a, b in pairs[60:]]


def test_order_matters():
    """The same runs in another order make other sketches, though the sets are nearly equal."""
    rng = random.Random(2)
    a, b = data.prose(rng, "en", 100), data.prose(rng, "en", 100)
    x, y = order_minhash.word_hashes(f"{a} {b}"), order_minhash.word_hashes(f"{b} {a}")
    agree = (order_minhash.sketches(x) == order_minhash.sketches(y)).mean()
    assert agree < 0.6
    assert not order_minhash.similar(f"{a} {b}".split(), f"{b} {a}".split())


def test_dedup_keeps_one_of_each_class(spark):
    docs = data.documents(spark)
    kept = order_minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted({r[0] for r in data.rows()} - {10100, 10101, 10109}, key=str)
    assert order_minhash.deduplicated(data.empty(spark)).count() == 0
    assert order_minhash.classes(data.empty(spark)).count() == 0


def test_dedup_of_null_and_repeated_ids(spark):
    """Different texts stay, whatever their ids; copies of one text are one row, with an id if any has one."""
    a, b, c, d = (data.prose(random.Random(i), "en", 40) for i in range(4))
    rows = [(None, a), (None, b), (7, c), (7, d), (None, a), (None, c), (None, "x y"), (None, "v w"), (None, ""), (None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in order_minhash.deduplicated(docs).collect()), key=str)
    assert got == sorted([(None, a), (None, b), (7, c), (7, d), (None, "x y"), (None, "v w"), (None, ""), (None, None), (3, "")], key=str)
    found = order_minhash.classes(docs).collect()
    assert len(found) == len(rows) and len({r.class_key for r in found}) == 9


def test_pairs_carry_words_in_shares(spark, monkeypatch):
    """Where pairs are many more than texts their words come share by share, and what the pairs were made of is gone by then."""
    rng = random.Random(4)
    lists = [[rng.randrange(1000) for _ in range(30)] for _ in range(4)]
    lists += [[*words[:-1], 1001 + i] for i, words in enumerate(lists * 4)]
    words = spark.createDataFrame(list(enumerate(lists)), "node long, words array<int>")
    scratch = Scratch(spark)
    pairs = scratch.write(spark.createDataFrame([(a, b) for a in range(20) for b in range(a)], "a long, b long"), "pairs")
    near, steps = order_minhash._in_shares(pairs, words, 0.8, scratch, "near")
    assert sorted(tuple(r) for r in near.collect()) == sorted((a, b) for a in range(20) for b in range(a) if (a - b) % 4 == 0)
    assert len(steps) == 10
    scratch.drop("pairs", *steps)
    held, verified = [], order_minhash._verified
    folder = pathlib.Path(shared_folder(spark), "sparkprep")
    before = {p.name for p in folder.iterdir()}

    def watched(*args):
        held.append({p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in before})
        return verified(*args)

    monkeypatch.setattr(order_minhash, "_verified", watched)
    found = order_minhash.classes(data.documents(spark))
    assert len(held) >= 3 and "buckets" in held[0]
    assert not held[-1] & {"buckets", "candidates-0", "candidates-1", "near-0-0", "near-1-0", "met-0"}
    assert found.count() == data.documents(spark).count()


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {n: n for e in edges for n in e}
    for _ in range(80):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    lone = {n for n in least if all(a == b or n not in (a, b) for a, b in edges)}
    assert got == {n: c for n, c in least.items() if n not in lone}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def spots(text):
    """Signatures by hand: each anchor that has a chain of content words after it."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    out, chain = set(), []
    for word in reversed(words):
        if word not in spotsigs.COMMON:
            chain = [word, *chain][: spotsigs.CHAIN]
        elif len(chain) == spotsigs.CHAIN:
            out.add(" ".join([word, *chain]))
    return out


def test_signatures_by_hand(spark):
    texts = [r[1] or "" for r in data.rows()]
    texts += ["the " * 50_000 + "end of it", "of " + "the " * 20 + "one two", "of " + "the " * 21 + "one " + "und " * 20 + "two three"]
    # a run of any length passes over, and between the words of a chain
    texts += ["of " + "the and " * 60_000 + "one " + "und " * 70_000 + "two three", "one of", "the one two", " of the of  one, of the two. "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("doc_id", "text")
    got = {r.doc_id: set(r.s) for r in rows.select("doc_id", spotsigs.signatures(rows.text).alias("s")).collect()}
    names = sorted(set().union(*map(spots, texts)))
    hashed = {r.n: r.h for r in spark.createDataFrame([(n,) for n in names], "n string").selectExpr("n", "xxhash64(n) h").collect()}
    for i, text in enumerate(texts):
        want = {hashed[s] for s in spots(text)}
        assert got[i] == want if want else len(got[i]) == 1


def test_compared_follows_the_next_document(spark):
    docs = data.documents(spark)
    got = spotsigs.compared(docs).collect()
    rows = sorted({(r[0], r[1] or "") for r in data.rows() if r[0] is not None and r[0] != 5})
    assert len(got) == docs.count()
    found = {r.doc_id: r for r in got}
    for (i, text), (_, after) in zip(rows, rows[1:]):
        if i == 4:
            continue  # the rows of id 5 are repeated
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = spots(text), spots(edited), spots(after)
        if a and b:
            assert abs(r.near_edited - len(a & b) / len(a | b)) < 1e-12
        if a and c:
            assert abs(r.near_next - len(a & c) / len(a | c)) < 1e-12
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1.0)
    # rows without an id come first, so the last row meets that one
    assert found[10109].edited_sha256 == hashlib.sha256(("a " + "t").encode()).hexdigest()
    assert found[10108].fingerprint == found[10109].fingerprint
    assert spotsigs.compared(data.empty(spark)).count() == 0
    one = spotsigs.compared(docs.where("doc_id = 0")).first()
    assert one.near_next == 1.0


def test_many_buckets_form_a_ring(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 7)
    docs = spark.createDataFrame([(i * i - 50, f"the text number{i} of all the rest{i}") for i in range(60)], "doc_id long, text string")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    led = {r.text: r.next_text for r in spotsigs.with_next(docs).collect()}
    assert led == dict(zip(texts, texts[1:] + texts[:1]))


def test_near_pairs_equal_brute_force(spark):
    texts = near_texts(seed=6, groups=10, copies=5) + ["the end", "the end", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.fillna("").select("doc_id", "text")
    signs = {r.doc_id: frozenset(r.s) for r in rows.select("doc_id", spotsigs.signatures(rows["text"]).alias("s")).collect()}
    least = {}
    for i, s in signs.items():
        least[s] = min(i, least.get(s, i))
    want = set()
    for x, y in itertools.combinations(least, 2):
        if len(x & y) >= 0.8 * len(x | y) - 1e-9:
            want.add(tuple(sorted((least[x], least[y]))))
    assert {(r.a, r.b) for r in spotsigs.near_pairs(docs).collect()} == want
    assert {r.doc_id: r.class_id for r in spotsigs.membership(docs).collect()} == {i: least[s] for i, s in signs.items()}


def test_marks_and_runs_lose_no_near_copy(spark):
    """What lengths, slots of words and rare runs rule out holds no near copy, at any length and repeats included."""
    rng = random.Random(31)
    lists = []
    for _ in range(80):
        words = [rng.randrange(60) for _ in range(rng.randrange(5, 70))]
        lists.append(words)
        for _ in range(4):
            own = list(words)
            for _ in range(rng.randrange(1 + int(0.25 * len(words)))):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = [rng.randrange(60)] * rng.randrange(3)
            lists.append(own)
    lists = [words for words in lists if len(words) >= 5]
    numbers = [[(w + 1) * 0x9E3779B1 % (1 << 31) for w in words] for words in lists]
    words = spark.createDataFrame(list(enumerate(numbers)), "node long, words array<int>")
    pairs = [(a, b) for a in range(len(lists)) for b in range(max(0, a - 12), a)]
    near = {(a, b) for a, b in pairs if order_minhash.similar(lists[a], lists[b])}
    possible = order_minhash._possible(spark.createDataFrame(pairs, "a long, b long"), order_minhash._marked(words), 0.8)
    left = {tuple(r) for r in possible.collect()}
    assert len(near) > 100 and near <= left and len(left) < len(pairs) / 2
    open_ = words.selectExpr("node", "size(words) n_words", "node c")
    runs = {}
    for row in order_minhash._rare_first(open_, words, 0.8).collect():
        runs.setdefault(row.node, set()).add(row.word)
    assert all(runs[a] & runs[b] for a, b in near)


def test_texts_with_a_common_passage_are_not_aligned(spark, monkeypatch):
    """Texts that share a passage and a vocabulary, but are no copies, are ruled out before their words are fetched."""
    rng = random.Random(32)
    vocabulary = [f"v{i}" for i in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    texts = [" ".join(rng.choices(vocabulary, k=90)) + " " + passage for _ in range(60)]
    near = texts[7].split()
    near[3:6] = ["x", "y"]
    met, verified = [], order_minhash._verified

    def watched(pairs, *rest):
        met.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(order_minhash, "_verified", watched)
    docs = spark.createDataFrame(list(enumerate([*texts, " ".join(near)])), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in order_minhash.classes(docs).collect()}
    assert found == {i: i for i in range(60)} | {60: 7}
    assert sum(met) < 10


@pytest.mark.parametrize("rows", [4, 256])
def test_members_of_a_bucket_meet_by_rows_of_a_fixed_size(spark, monkeypatch, rows):
    """All near copies within large and small buckets are among the pairs; what meets carries no lists that grow with a text."""
    monkeypatch.setattr(order_minhash, "LIST_ROWS", rows)
    rng = random.Random(33)
    lists = []
    for _ in range(40):
        words = [rng.randrange(25) for _ in range(rng.randrange(20, 60))]
        for _ in range(4):
            own = list(words)
            for _ in range(rng.randrange(1 + int(0.2 * len(words)))):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = [rng.randrange(25)] * rng.randrange(3)
            lists.append(own)
    numbers = [[(w + 1) * 0x9E3779B1 % (1 << 31) for w in words] for words in lists]
    words = spark.createDataFrame(list(enumerate(numbers)), "node long, words array<int>")
    # the first text leads a bucket of all, every tenth text one of a few
    members = [(0, i) for i in range(len(lists))] + [(1 + i // 10, i) for i in range(len(lists))]
    shared = spark.createDataFrame([(k, i, len(lists[i]), 0 if k == 0 else (k - 1) * 10) for k, i in members], "key long, node long, n_words long, leader long")
    found = spark.createDataFrame([(0, 0), (1, 0)], "node long, component long")
    steps, write = {}, order_minhash.Scratch.write

    def watched(self, df, name):
        steps[name] = df.dtypes
        return write(self, df, name)

    monkeypatch.setattr(order_minhash.Scratch, "write", watched)
    got = {tuple(r) for r in order_minhash._across(shared, found, words, 0.8, order_minhash.Scratch(spark)).collect()}
    near = {(a, b) for a in range(1, len(lists)) for b in range(1, a) if order_minhash.similar(lists[a], lists[b])}
    assert len(near) > 50 and near <= got and len(got) < len(lists) ** 2 / 4
    assert not [c for name in steps if name.startswith(("rare-words", "dealt", "met")) for c in steps[name] if c[1].startswith("array")]
