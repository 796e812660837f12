"""Event logs, prefix tries and structure repair against brute force, on tables with every awkward case."""

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import groupby

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect

from sparkprep.llm import chat_events, ordered, prefix_trie, queries, structure_repair
from sparkprep.llm.chat_events import Template, read_turns, unescaped
from sparkprep.llm.structure_repair import Viterbi

CONVERSATIONS = "conv_id long, turn long, role string, text string, piece int, carry0 long, depth string, row string"
MARKS = r"\### Assistant: </turn> ok"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc(text: str) -> int:
    return zlib.crc32(text.encode())


def conversation_rows(seed: int = 1) -> list[tuple]:
    """Copies, prefixes of each other, gaps, null and repeated turns, unknown roles, marks, long and empty texts."""
    rng = random.Random(seed)
    texts = ["Yes.", "no", "Why?", "", " ", None, "a: b\n### c", MARKS, "\\", "</turn>\n", "É ü 🙂!", "done. ", "x\x85", "Fin.\t"]
    out = []
    for conv in (*range(0, 24), -3, -5, -8, 10**17 + 5, 10**17 + 6):
        n = rng.randrange(1, 14)
        roles = [rng.choice(["user", "assistant", "assistant", "user", "system", "tool", None, "", "us: er\n"]) for _ in range(n)]
        if conv % 3 == 0:
            roles = (["system"] if conv % 2 else []) + ["user", "assistant"] * 7
        out += [(conv, i, roles[i], rng.choice(texts)) for i in range(n)]
    copied = [r for r in out if r[0] == 7]
    for copy in (30, 31, 35, 40):
        out += [(copy, *r[1:]) for r in copied]
    long = [(50, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(60)]
    out += long
    for cut in (1, 5, 20, 59):
        out += [(50 + 5 * cut, *r[1:]) for r in long[:cut]]
    out += [(60, None, "user", "first?"), (60, 4, "assistant", "late."), (60, 9, "user", "later"), (60, 4, "assistant", "late.")]
    out += [(61, None, "user", "only"), (62, 3, "user", "x" * 300_000), (62, 7, "assistant", "word. " * 40_000)]
    out += [(1000 + i, 0, "user", "alone.") for i in (1, 2, 3, 4)]  # no conversation 1000: turnless when rebuilt
    out += [(None, 0, "user", "of no conversation"), (None, 1, "assistant", "same.")]
    rng.shuffle(out)
    return [(*r, 1, 2, "x", "y") for r in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("conversations"))
    spark.createDataFrame(conversation_rows(), CONVERSATIONS).repartition(5).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nothing"))
    spark.createDataFrame([], CONVERSATIONS).write.parquet(f"{path}/conversations.parquet")
    return path


def by_conversation(rows, key=lambda r: r[2:4]):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r[1:4])
    return {c: sorted(t, key=lambda r: (r[0] is not None, r[0] or 0, key((c, *r)))) for c, t in out.items()}


def plain(rows, null=""):
    return [(c, t, null if r is None else r, null if x is None else x) for c, t, r, x, *_ in rows]


# running totals


def test_running_totals_do_not_depend_on_pieces(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 1, 2]), i, rng.randrange(-5, 100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, i long, v long")
    from pyspark.sql import functions as F

    totals = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "x": ("bit_xor", F.col("v"))}
    got = {r["i"]: (r["s"], r["m"], r["x"]) for r in ordered.running(df, ["g"], ["i"], totals).collect()}
    seen = defaultdict(list)
    for g, i, v in rows:
        x = 0
        for w in seen[g]:
            x ^= w
        assert got[i] == ((sum(seen[g]), max(seen[g]), x) if seen[g] else (None, None, None))
        seen[g].append(v)


# event logs


def fold(log):
    """A log's messages by the rules, one conversation after another."""
    out = {}
    for conv, events in groupby(sorted(log, key=lambda e: (e[0] is not None, e[0] or 0, e[1])), key=lambda e: e[0]):
        live, opened, gone = {}, {}, set()
        for _, seq, message, kind, role, text in events:
            if kind == "open":
                if message not in opened:
                    opened[message], live[message] = seq, [role or "", text or ""]
            elif message in opened:
                if kind == "delta":
                    live[message][1] += text or ""
                elif kind == "edit":
                    live[message][1] = text or ""
                elif kind == "regenerate":
                    live[message][1] = ""
                    gone |= {m for m, s in opened.items() if s > opened[message]}
        out[conv] = [tuple(live[m]) for m in sorted(opened, key=opened.get) if m not in gone]
    return out


def test_logs_fold_to_messages(spark):
    rng = random.Random(5)
    log = []
    for conv in (None, 1, 2, 3, 4, 5, 6):
        for seq in range(rng.randrange(1, 120)):
            kind = rng.choice(["open", "open", "delta", "delta", "delta", "edit", "regenerate", "noise"] if conv != 6 else ["open", "delta"])
            log.append((conv, seq, f"m{rng.randrange(25)}", kind, rng.choice(["user", "assistant", None]), rng.choice([None, "", "a", "bc", MARKS])))
    rng.shuffle(log)
    df = spark.createDataFrame([(*e, 1, "x") for e in log], "conv_id long, seq long, message string, kind string, role string, text string, opened int, pieces string")
    got = defaultdict(list)
    for r in sorted(chat_events.messages(df).collect(), key=lambda r: r["opened"]):
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert got == {c: m for c, m in fold(log).items() if m}
    assert sum(len(m) for m in got.values()) < sum(len({e[2] for e in log if e[0] == c and e[3] == "open"}) for c in got)


def test_the_loss_mask_covers_learned_texts_only(spark):
    log = [(1, 0, "a", "open", "system", "S"), (1, 1, "b", "open", "assistant", None), (1, 2, "b", "delta", None, "x</turn>"), (1, 3, "c", "open", "user", "assistant")]
    df = spark.createDataFrame(log, "conv_id long, seq long, message string, kind string, role string, text string")
    rows = sorted(chat_events.format_log(df).collect(), key=lambda r: r["opened"])
    assert "".join(r["segment"] for r in rows) == "### system: S</turn>\n### assistant: x\\</turn></turn>\n### user: assistant</turn>\n"
    assert [None if r["loss_start"] is None else r["segment"][r["loss_start"] : r["loss_end"]] for r in rows] == [None, "x\\</turn>", None]


def segment(role, text, t=Template()):
    from re import escape, sub

    def guarded(s, marks):
        return sub("|".join(escape(m) for m in marks), lambda m: t.escape + m.group(), s)

    return t.start + guarded(role, t.marks() + [t.role_end]) + t.role_end + guarded(text, t.marks()) + t.end


PIECES = st.lists(st.sampled_from(["\\", "### ", "</turn>", "\n", ": ", ":", "#", "</tur", "a", "é", " "]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4), st.integers(1, 9))
def test_any_text_comes_back_whatever_the_pieces(turns, width):
    text = "".join(segment(r, x) for r, x in turns)
    assert list(read_turns(text[i : i + width] for i in range(0, len(text), width))) == turns


@pytest.mark.parametrize("bad", [{"end": "aa"}, {"start": "\\x"}, {"role_end": ""}, {"escape": "ab"}, {"end": "abab"}])
def test_marks_that_cannot_be_escaped_are_refused(bad):
    with pytest.raises(ValueError):
        Template(**bad)


def test_a_cut_text_is_refused():
    with pytest.raises(ValueError):
        list(read_turns(["### user: a</tur"]))
    with pytest.raises(ValueError):
        list(read_turns(["user"]))


def test_op11_against_brute_force(spark, folder):
    rows = plain(conversation_rows()) + [(-7, 0, "user", MARKS), (-7, 1, "assistant", MARKS)]
    got = {r["conv_id"]: r for r in queries.op11_chat_events(spark, folder).collect()}
    turns = by_conversation(rows)
    assert got.keys() == turns.keys()
    for conv, said in turns.items():
        if conv in (60, 61):  # rows of one turn: any order of equal rows
            assert got[conv]["n_turns"] == len(said)
        learned = "".join(x for _, r, x in said if r == "assistant")
        assert got[conv]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in said)), conv
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(learned), sha(learned))
        assert got[conv]["formatted_chars"] == sum(len(segment(r, x)) for _, r, x in said)


def test_the_log_of_a_table_edits_and_regenerates(spark, folder):
    log = chat_events.as_log(spark.read.parquet(f"{folder}/conversations.parquet").drop("row").selectExpr("*", "uuid() as row")).groupBy("kind").count()
    kinds = {r["kind"]: r["count"] for r in log.collect()}
    assert kinds["open"] > 200 and kinds["delta"] > 200 and kinds["edit"] > 10 and kinds["regenerate"] > 10


def test_unescaped():
    assert unescaped(r"\\a\### \</turn>") == "\\a### </turn>"


# prefix tries


def trie_of(conversations: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    nodes = defaultdict(list)
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(conv)
    kids = defaultdict(list)
    for name in nodes:
        if name:
            kids[name[:-1]].append(name)
    out = set()
    below: dict[tuple, tuple[int, int]] = {}
    for name in sorted(nodes, key=len, reverse=True):
        members = nodes[name]
        own = (len(members) - 1) * len(name[-1][1].encode()) if name else 0
        leaves = sum(below[k][0] for k in kids[name]) or 1
        below[name] = (leaves, own + sum(below[k][1] for k in kids[name]))
        ends = sorted(c for c in members if len(conversations[c]) == len(name))
        up = min(nodes[name[:-1]]) if name else None
        out.add((min(members), len(name), up, len(members), len(kids[name]), *below[name], sha(",".join(map(str, ends)))))
    return out


def nodes_of(df) -> list[tuple]:
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return [tuple(r) for r in df.select(*names).collect()]


def test_op12_against_brute_force(spark, folder):
    own = {c: [(r, x) for _, r, x in t] for c, t in by_conversation([r for r in plain(conversation_rows()) if r[0] is not None]).items()}
    built = {}
    for c, turns in own.items():
        h = crc(str(c)) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    got = nodes_of(queries.op12_prefix_trie(spark, folder))
    want = trie_of(built)
    assert len(got) == len(want) and set(got) == want
    assert any(not t for t in built.values()) and max(map(len, built.values())) >= 59


def test_a_log_of_every_prefix_peels_turn_by_turn(spark):
    rows = [(c, i, "user", f"t{i}") for c in range(12) for i in range(12 - c)] + [(c, i, "user", f"t{i}") for c in range(20, 26) for i in range(c - 19)]
    from pyspark.sql import functions as F

    turns = prefix_trie.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    nodes = prefix_trie.trie(*prefix_trie.rebuilt(turns, F.lit(0), F.col("conv_id"), 0))
    want = trie_of({c: [(r, x) for _, r, x in t] for c, t in by_conversation(rows).items()})
    assert sorted(nodes_of(nodes), key=repr) == sorted(want, key=repr)


# structure repair


def repaired(rows):
    """Cheapest repair by trying every edit, whole edit strings compared. ``rows``: (role, text, fault)."""
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def inserted(paths):
        out = dict(paths)
        for _ in range(3):
            for state, (cost, audit, said) in list(out.items()):
                new = "assistant" if state == "u" else "user"
                offer = (cost + 2, audit + "I", said + ((new, ""),))
                out[new[0]] = min(out.get(new[0], offer), offer)
        return out

    best = inserted(best)
    for role, text, fault in rows:
        late = fault == "truncated"
        step = {}
        for state, (cost, audit, said) in best.items():
            new = "assistant" if state == "u" else "user"
            offers = [(state, (cost + 3, audit + "D", said))]
            if fault not in ("blank", "duplicate"):
                offers.append((new[0], (cost + 2 + late, audit + "R", said + ((new, text),))))
                if (state, role[:1]) in follows:
                    offers.append((role[0], (cost + late, audit + "K", said + ((role, text),))))
            for to, offer in offers:
                step[to] = min(step.get(to, offer), offer)
        best = inserted(step)
    return min(best[s] for s in ("", "a") if s in best)


def searched(rows):
    search, edits, most = Viterbi(), [], 0
    for row in rows:
        edits += list(search.push(*row))
        if len(rows) < 100 or random.random() < 0.1:
            most = max([most] + [len(search._path(n)) for _, n in search.best.values()])
    cost, rest = search.finish()
    edits += list(rest)
    return cost, "".join(e[0] for e in edits), tuple(e[1:] for e in edits if e[0] != "D"), most


FAULTS = st.sampled_from([None, None, None, "truncated", "truncated", "blank", "duplicate"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "admin"]), st.just("t"), FAULTS), max_size=14))
def test_the_search_finds_the_first_of_the_cheapest_repairs(rows):
    assert searched(rows)[:3] == repaired(rows)


@pytest.mark.parametrize("seed", range(6))
def test_settled_edits_leave_the_search(seed):
    """Mixed rows settle soon, however long the conversation is."""
    rng = random.Random(seed)
    roles = (["user", "assistant"], ["user", "assistant", "system", "tool"])[seed % 2]
    rows = [(rng.choice(roles), "t", rng.choice([None, None, "truncated", "duplicate", "blank"][: 2 + seed % 4])) for _ in range(5000)]
    assert searched(rows)[3] < 300


def test_what_hangs_on_the_last_row_is_held_till_then():
    even, odd = [("user", "t", None)] * 4000, [("user", "t", None)] * 4001
    assert searched(even)[:2] == (4000, "KR" * 2000) and searched(odd)[:2] == (4002, "KI" + "KR" * 2000)


def test_op13_against_brute_force(spark, folder, nothing):
    want = {}
    rows = [r for r in plain(conversation_rows(), " ") if r[0] is not None]
    hurt = []
    for c, t, role, text in rows:
        m = crc(f"{c}:{' ' if t is None else t}") % 20
        if m == 0:
            continue
        text = "" if m == 1 else "".join(x for x in text if x not in ".!?") if m == 2 else text
        hurt += [(c, t, "user" if m == 4 else role, text)] * (2 if m == 3 else 1)
    damaged = by_conversation(hurt)
    for conv in {r[0] for r in rows}:
        seen, faults = set(), []
        for _, role, text in damaged.get(conv, []):
            solid = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else None if solid[-1] in ".!?" else "truncated")
            seen.add((role, text))
        said = damaged.get(conv, [])
        cost, audit, turns = repaired([(r, x, f) for (_, r, x), f in zip(said, faults)])
        known = [t for t, _, _ in said if t is not None]
        initials = [r[:1] for _, r, _ in said]
        want[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
            sha("\n".join(f"{r}:{x}" for r, x in turns)),
        )
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r["conv_id"]: tuple(r[n] for n in names) for r in queries.op13_structure_repair(spark, folder).collect()}
    assert got == want
    assert any(not damaged.get(c) for c in want) or len(want) > 20


def test_edits_tell_what_became_of_every_row(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "tool", "so."), (1, 3, "user", "And?")]
    edits = structure_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("place").collect()
    assert [(e["edit"], e["turn"], e["fault"], e["was"], e["role"], e["text"]) for e in edits] == [
        ("K", 0, None, "user", "user", "Hi."),
        ("D", 1, "duplicate", "user", None, None),
        ("R", 2, None, "tool", "assistant", "so."),
        ("K", 3, None, "user", "user", "And?"),
        ("I", None, None, None, "assistant", ""),
    ]


# all three


def test_empty_tables(spark, nothing):
    assert [r["conv_id"] for r in queries.op11_chat_events(spark, nothing).collect()] == [-7]
    assert queries.op12_prefix_trie(spark, nothing).collect() == []
    assert queries.op13_structure_repair(spark, nothing).collect() == []


@pytest.mark.parametrize("name", ["op11_chat_events", "op12_prefix_trie", "op13_structure_repair"])
def test_queries_against_sql(spark, name):
    from oracle import compare

    assert compare(spark, connect("/root/testdata/sf0.001"), name, "/root/testdata/sf0.001", queries.QUERIES, queries.ORACLES) is None
