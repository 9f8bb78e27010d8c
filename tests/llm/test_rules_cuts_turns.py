"""Quality rules, fill-in-the-middle texts and conversation repair against brute force, and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from featurevote.llm import conversations, fill_middle, quality_rules
from featurevote.llm.queries import QUERIES

ODD = [
    (1, "The cat sat on the mat, and the cat sat on the mat again.", "en"),
    (1, "The cat sat on the mat, and the cat sat on the mat again.", "en"),
    (2, "", None),
    (3, None, "de"),
    (None, " \t\x0b\n", "en"),
    (None, None, None),
    (5, "É 漢字 <P> don't\n\ndon't\r\n don't", "en"),
    (7, "long word " * 40_000 + "end", "en"),
    (8, "$ab% " * 300, "en"),
    (9, " ".join(f"w{i}" for i in range(3_000)) * 2, "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 1, "y", 2) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long, h1 string, n_words int")


@pytest.fixture(scope="module")
def texts(sf_dir):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())


# Quality rules


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = collections.Counter(windows), set()
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered.update(range(i, i + 8))
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(sign in "#*$%&|<>" for sign in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_statistics_equal_brute_force(spark, sf_dir, texts, odd):
    for r in QUERIES["op11_quality_rules"](spark, sf_dir).collect():
        want = brute_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in BASE) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    got = [(r["doc_id"], *(r[c] for c in BASE)) for r in quality_rules.text_statistics(odd).collect()]
    assert sorted(got, key=str) == sorted(((i, *brute_counts(t)) for i, t, _ in ODD), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_repeated_windows_of_random_words(spark, seed):
    draw = random.Random(seed)
    made = [(i, " ".join(draw.choice("ab" if i % 2 else "abcdefgh") for _ in range(draw.randrange(60)))) for i in range(60)]
    passage = " ".join(f"p{i}" for i in range(20))
    made += [(100 + i, f"{passage} {'x ' * i}{passage}") for i in range(12)]
    got = quality_rules.text_statistics(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_repeat_words"] for r in got} == {i: brute_counts(t)[4] for i, t in made}


def test_rules_hold_on_labels_that_were_not_learned(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    half = F.crc32(F.concat(F.lit("half"), F.col("doc_id").cast("string")).cast("binary")) % 2 == 0
    statistics = quality_rules.written(quality_rules.text_statistics(docs))
    rules = quality_rules.learn_rules(statistics, labels.where(half))
    assert rules
    found = quality_rules.judged(statistics, rules).join(labels.where(~half), "doc_id").where("NOT base_failed")
    counts = {(r["quality"], r["kept"]): r["n"] for r in found.groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    rejected = counts.get((0, False), 0)
    assert rejected >= 0.95 * (rejected + counts.get((0, True), 0)) > 0
    assert counts.get((1, False), 0) <= 0.002 * counts[1, True]


def planted(spark, n=600):
    """Rejected: many symbols, or long words in long lines. Other texts have one of these two only."""
    draw = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        symbols, long_words, long_lines = i % 7 == 0, draw.random() < 0.5, draw.random() < 0.5
        word = "abcdefghijkl" if long_words else "abc"
        words = [f"{word}{draw.randrange(10**6)}" + ("$$" if symbols and draw.random() < 0.6 else "") for _ in range(60)]
        docs.append((i, ("" if long_lines else "\n").join(f"{w} " for w in words)))
        labels.append((i, 0 if symbols or (long_words and long_lines) else 1))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_rules_are_conjunctions_in_order(spark):
    docs, labels = planted(spark)
    statistics = quality_rules.written(quality_rules.text_statistics(docs))
    rules = quality_rules.learn_rules(statistics, labels)
    assert any(len(rule) > 1 for rule in rules)
    judged = quality_rules.judged(statistics, rules).join(labels, "doc_id").collect()
    assert all(r["kept"] == (r["quality"] == 1) for r in judged)

    def value(row, name):
        part, whole = quality_rules.MEASURES[name]
        return row[part] / row[whole] if row[whole] else 0.0

    for r in judged:
        covering = [
            i for i, rule in enumerate(rules, 1) if all((value(r, c.measure) > c.threshold) == c.above for c in rule)
        ]
        assert r["rule"] == (covering[0] if covering else None)


def test_noise_in_labels_makes_no_rules_and_odd_labels_do_not_fail(spark, odd):
    docs, labels = planted(spark)
    statistics = quality_rules.written(quality_rules.text_statistics(docs))
    noise = labels.withColumn("quality", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2)
    assert quality_rules.learn_rules(statistics, noise) == []
    twice = labels.union(labels.withColumn("quality", F.lit(None).cast("int"))).union(
        spark.createDataFrame([(None, 0), (10**9, 0)], labels.schema)
    )
    assert quality_rules.learn_rules(statistics, twice) == quality_rules.learn_rules(statistics, labels)
    for few in (labels.limit(0), labels.where("quality = 1"), labels.where("quality = 0")):
        rules = quality_rules.learn_rules(statistics, few)
        assert rules == []
        assert quality_rules.judged(statistics, rules).where("kept = base_failed").count() == 0
    of_odd = quality_rules.text_statistics(odd)
    assert quality_rules.judged(of_odd, quality_rules.learn_rules(of_odd, labels)).count() == len(ODD)
    empty = quality_rules.text_statistics(odd.limit(0))
    assert quality_rules.judged(empty, quality_rules.learn_rules(empty, labels)).count() == 0


def test_statistics_need_no_python_workers(spark, sf_dir):
    plan = QUERIES["op11_quality_rules"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# Fill in the middle


def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_middles_equal_brute_force_and_go_back(spark, odd):
    draw = random.Random(5)
    made = [(i, "".join(draw.choice(["a", "Bc", "<", ">", "P", "S", "<P", "<S", "M>", " ", "\n", "é", "𝒳"]) for _ in range(draw.randrange(40)))) for i in range(500)]
    docs = odd.select("doc_id", "text", "n", "h1").union(spark.createDataFrame(made, "doc_id long, text string").selectExpr("*", "0", "''"))
    got = fill_middle.fill_in_middle(docs)
    rows = got.withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = [brute_middle(i, t) for i, t in [r[:2] for r in ODD] + made]
    assert sorted([tuple(r)[:-1] for r in rows], key=str) == sorted(want, key=str)
    assert {r["form"] for r in rows} == {"plain", "spm", "psm"}
    assert sorted(r["again"] for r in rows) == sorted(t or "" for _, t in [r[:2] for r in ODD] + made)
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("part", [1, 2, 5, 1000])
def test_units_in_parts(part):
    draw = random.Random(part)
    for _ in range(200):
        text = "".join(draw.choice("ab .\né") for _ in range(draw.randrange(40)))
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        found = fill_middle.Units(text, part_chars=part)
        ends = [len("".join(units[:k])) for k in range(len(units) + 1)]
        assert found.n == len(units) and [found.end(k) for k in range(len(units) + 1)] == ends


def test_millions_of_units():
    text = "ab," * 3_000_000
    found = fill_middle.Units(text)
    assert found.n == 6_000_000 and found.end(5_999_999) == len(text) - 1 and found.end(3) == 5


# Conversations


def faults_of(rows):
    found, seen = [], set()
    for role, text in rows:
        visible = re.sub(r"[\x20\x09-\x0D]+", "", text)
        fault = "truncated" if visible and visible[-1] not in ".!?" else None
        found.append("blank" if not visible else "duplicate" if (role, text) in seen else fault)
        seen.add((role, text))
    return found


def brute_repair(rows):
    """(cost, audit, repaired turns), by whole strings of edits for each state."""

    def state(turns):
        signs = "".join(role[:1] or "?" for role, _ in turns)
        if not re.fullmatch("s?(ua)*u?", signs):
            return None
        return signs[-1:]

    def add(best, turns, cost, audit):
        at = state(turns)
        if at is not None and (at not in best or (cost, audit) < best[at][:2]):
            best[at] = (cost, audit, turns)

    def with_inserts(best):
        for _ in range(3):
            for cost, audit, turns in list(best.values()):
                for role in ("user", "assistant"):
                    add(best, turns + ((role, ""),), cost + 2, audit + "I")
        return best

    best = with_inserts({"": (0, "", ())})
    for (role, text), fault in zip(rows, faults_of(rows)):
        following = {}
        for cost, audit, turns in best.values():
            add(following, turns, cost + 3, audit + "D")
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            add(following, turns + ((role, text),), cost + extra, audit + "K")
            for other in ("user", "assistant"):
                add(following, turns + ((other, text),), cost + 2 + extra, audit + "R")
        best = with_inserts(following)
    return min((best[at] for at in ("", "a") if at in best), key=lambda b: b[:2])


def all_repairs(rows):
    """The least (cost, audit) over all sequences of edits, tried one by one."""
    faults, best = faults_of(rows), (10**9, "")

    def go(i, cost, audit, signs, inserts):
        nonlocal best
        if cost > best[0] or not re.fullmatch("s?(ua)*u?", signs):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", signs):
            best = min(best, (cost, audit))
        if inserts:
            for sign in "ua":
                go(i, cost + 2, audit + "I", signs + sign, inserts - 1)
        if i < len(rows):
            go(i + 1, cost + 3, audit + "D", signs, 2)
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                go(i + 1, cost + extra, audit + "K", signs + (rows[i][0][:1] or "?"), 2)
                for sign in "ua":
                    go(i + 1, cost + 2 + extra, audit + "R", signs + sign, 2)

    go(0, 0, "", "", 2)
    return best


def random_turns(draw, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "u", ""]
    return [(draw.choice(roles), draw.choice(["a.", "b", "c!", "", "d?", " \t", "e.x", "f. ", f"{draw.randrange(99)}."])) for _ in range(n)]


def test_search_equals_brute_force():
    draw = random.Random(11)
    for trial in range(3000):
        rows = random_turns(draw, draw.randrange(6 if trial % 2 else 40))
        found, out = conversations.Survivors(), []
        for (role, text), fault in zip(rows, faults_of(rows)):
            found.step(role, fault, (role, text))
            out += [(n.edit, n.role, n.row) for n in found.resolved()]
        out += [(n.edit, n.role, n.row) for n in found.rest()]
        cost, audit, repaired = brute_repair(rows)
        assert "".join(o[0] for o in out) == audit
        assert tuple((role, row[1] if row else "") for edit, role, row in out if edit != "D") == repaired
        if len(rows) < 5:
            assert all_repairs(rows) == (cost, audit)


def open_nodes(found):
    """Nodes below the root, by following the tree."""
    below, todo = 0, [found.root]
    while todo:
        node = todo.pop()
        below += len(node.next)
        todo += node.next
    return below


def test_memory_of_a_long_dialogue_is_bounded():
    found, given = conversations.Survivors(), 0
    for i in range(20_000):
        fault = "blank" if i % 13 == 0 else "truncated" if i % 7 == 0 else None
        found.step(("user", "assistant")[i % 2] if i % 11 else "user", fault, (i,))
        given += sum(1 for _ in found.resolved())
        assert open_nodes(found) < 60
    assert given > 19_000


def test_references_count_what_is_there():
    draw = random.Random(2)
    for _ in range(50):
        found = conversations.Survivors()
        for (role, text), fault in zip(rows := random_turns(draw, 30), faults_of(rows)):
            found.step(role, fault, None)
            todo = [found.root]
            while todo:
                node = todo.pop()
                assert node.refs == len(node.next) + sum(node is n for n in found.nodes)
                todo += node.next


def test_long_open_stretches_take_no_square_time():
    found = conversations.Survivors()
    for _ in range(60_000):
        found.step("tool", None, None)
    assert "".join(n.edit for n in found.rest()) == "R" * 60_000


def brute_report(turns):
    """What the query returns, from (conv_id, turn, role, text) rows."""
    of = {}
    for conv, turn, role, text in turns:
        of.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            of[conv] += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    found = []
    for conv, rows in of.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        known = [r[0] for r in rows if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        said = [r[1:] for r in rows]
        faults = collections.Counter(faults_of(said))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        cost, audit, repaired = brute_repair(said)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        found.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest))
    return sorted(found, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_conversations_equal_brute_force(spark, folder):
    got = QUERIES["op13_conversation_repair"](spark, folder)
    turns = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{folder}/conversations.parquet'").fetchall()
    assert sorted([tuple(r) for r in got.select(*COLUMNS).collect()], key=str) == brute_report(turns)


@pytest.fixture(scope="module")
def odd_turns():
    draw = random.Random(4)
    rows = [(None, i, *t) for i, t in enumerate(random_turns(draw, 30))]
    rows += [(1, None, "user", "No turn."), (1, None, None, None), (1, 3, "user", "Same."), (1, 3, "user", "Same."), (1, 3, "assistant", "Other.")]
    rows += [(2, 7, None, None), (3, None, "user", "x.")]
    rows += [(4, i, *t) for i, t in enumerate(random_turns(draw, 4000))]
    rows += [(5, i, "user", "Again and again.") for i in range(3000)]
    rows += [(6, i, "user", "") for i in range(50)]
    rows += [(7, 1, "user", "long " * 100_000 + "."), (7, 2, "assistant", "é ")]
    rows += [(100 + i, 0, "user", "Dropped or not.") for i in range(60)]
    return rows


def test_odd_conversations(spark, tmp_path, odd_turns):
    rows = [(*r, "x", 1) for r in odd_turns]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, place int")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()
    want = brute_report(odd_turns)
    assert sorted([tuple(r[c] for c in COLUMNS) for r in got], key=str) == want
    assert sum(w[7] == "" for w in want) >= 1  # nothing left after the damage
    assert conversations.report(conversations.repair(table.limit(0))).count() == 0


def test_edits_hold_the_repaired_turns(spark, odd_turns):
    table = spark.createDataFrame(odd_turns, "conv_id long, turn long, role string, text string")
    edits = collections.defaultdict(list)
    for r in conversations.repair(table).collect():
        edits[r["conv_id"]].append(r)
    for conv, found in edits.items():
        found.sort(key=lambda r: r["place"])
        assert [r["place"] for r in found] == list(range(1, len(found) + 1))
        signs = "".join(r["role"][:1] for r in found if r["edit"] != "D")
        assert re.fullmatch("(s?(ua)+)?", signs)
        n_rows = sum(t[0] == conv for t in odd_turns)
        assert sum(r["edit"] != "I" for r in found) == n_rows
        assert all(r["edit"] == "D" for r in found if r["fault"] in ("blank", "duplicate"))
