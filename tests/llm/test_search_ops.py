"""Fixity, repeats, chat, Jaccard join and nearest vectors against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticelake.llm import ann, chat, fixity, graph, jaccard, mixing, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_groups(rows, width, percent):
    sets = {}
    for i, t, _ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    least = {i: i for i in sets}
    for _ in range(len(sets)):
        moved = False
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if a != b and sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]) and least[b] < least[a]:
                    least[a], moved = least[b], True
        if not moved:
            break
    return {i: (len(s), least[i]) for i, s in sets.items()}


@pytest.fixture(scope="module")
def near_copies():
    rng, rows = random.Random(5), []
    for _ in range(14):
        base = [f"W{rng.randint(0, 60)}" for _ in range(rng.choice([1, 2, 3, 5, 12, 40]))]
        for _ in range(rng.randint(1, 7)):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = f"w{rng.randint(0, 60)}"
            rows.append((len(rows), " ".join(words), "a"))
    return rows + [(900, "", "a"), (901, None, "a"), (902, " \n", "a")]


@pytest.mark.parametrize("width,percent,block,common", [(3, 90, 2_000_000, 16), (5, 80, 120, 2), (1, 80, 120, 1)])
def test_jaccard(documents, near_copies, monkeypatch, width, percent, block, common):
    monkeypatch.setattr(jaccard, "GROUP_ELEMENTS", block)
    monkeypatch.setattr(jaccard, "COMMON", common)
    want = plain_groups(near_copies, width, percent)
    got = jaccard.jaccard_groups(documents(near_copies), width, percent).collect()
    assert len(got) == len(near_copies)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_jaccard_repeated_rows_and_null_ids(documents):
    rows = [(1, "a b c d", "a"), (1, "x y z", "a"), (0, "A b c d", "a"), (0, "A b c d", "a"), (None, "a b c d", "a"), (None, "q r s", "a"), (None, "q r s", "a"), (3, "X y z", "a")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(documents(rows)).collect()), key=str)
    assert got == sorted([(1, 2, 0), (1, 1, 0), (0, 2, 0), (0, 2, 0), (None, 2, 0), (None, 1, None), (None, 1, None), (3, 1, 0)], key=str)
    kept = jaccard.one_of_each(documents(rows))
    assert kept.columns == documents(rows).columns and [r["doc_id"] for r in kept.filter("doc_id = 0").collect()] == [0]


def test_texts_that_share_a_doc_id_or_have_none(documents):
    rng = random.Random(8)
    a, b, c, d = (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60)) for _ in range(4))
    rows = [(1, a, "s"), (5, a + " end", "s"), (5, b, "s"), (5, b, "s"), (7, c, "s"), (7, d, "s"), (9, c + " end", "s"), (None, d, "s")]
    rows += [(None, f"{a} {b}", "s")] * 40 + [(None, "", "s")] * 3 + [(None, None, "s")] * 2
    got = jaccard.one_of_each(documents(rows))
    found = sorted(((r["doc_id"], r["text"] or "") for r in got.collect()), key=repr)
    assert found == sorted([(1, a), (5, b), (7, c), (7, d), (None, f"{a} {b}"), (None, "")], key=repr)


def test_mix_takes_equal_rows_as_often_as_it_says(spark, documents):
    import corpus_pipeline

    rng = random.Random(9)
    rows = [(i % 40 if i % 3 else None, f"x{i % 40} " * (1 + i % 40), rng.choice("ab")) for i in range(300)]
    want = defaultdict(int)
    d = documents(rows).coalesce(1)
    texts = {r["k"]: r["text"] for r in d.select(F.xxhash64("text").alias("k"), "text").collect()}
    for r in mixing.mix_sources(d).collect():
        want[r["doc_id"], texts[r["text_key"]], r["source"]] += r["copies"]
    got = defaultdict(int)
    for r in corpus_pipeline.mix_stage(spark, d, "").collect():
        got[r["doc_id"], r["text"], r["source"]] += 1
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("one_task", [0, 500_000])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1100)]
    least = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert {k: least[k] for k in got} == got and set(got) == {x for a, b in edges if a != b for x in (a, b)}


def plain_removal(rows, width):
    first, out = {}, []
    words = [WORD.findall(t or "") for _, t, _ in rows]
    ids = [float("inf") if i is None else i for i, _, _ in rows]
    for i, w in zip(ids, words):
        for k in range(len(w) - width + 1):
            first[tuple(w[k : k + width])] = min(i, first.get(tuple(w[k : k + width]), i))
    for i, w in zip(ids, words):
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((None if i == float("inf") else i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width,group", [(13, 250_000), (13, 3), (3, 20)])
def test_repeats(documents, monkeypatch, width, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(2)
    parts = ["a b c d e f g h i j k l m n o p", "x y z", "a a a a a a a a a a a a a a", "q r s t u v a b c d e f g h i j k l"]
    rows = [(i * 7 % 101, " ".join(rng.choice([*parts, f"w{rng.randint(0, 9)}"]) for _ in range(rng.randint(0, 9))), "a") for i in range(100)]
    rows += [(500, None, "a"), (501, "", "a"), (None, parts[0] + " tail", "a"), rows[3], (rows[3][0], "other text of one doc_id " + parts[3], "a")]
    got = repeats.remove_repeats(documents(rows), width).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == plain_removal(rows, width)


def plain_maximal(rows, width, most):
    """Maximal repeats between different texts, each to `most` words: {words as a tuple: (places, documents, smallest doc_id)}."""
    texts = {}
    for i, t, _ in rows:
        texts[t] = min(i, texts.get(t, i))
    spots = defaultdict(list)
    for t, i in texts.items():
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1):
            for n in range(width, len(w) - k + 1):
                spots[tuple(w[k : k + n])].append((i, w[k - 1] if k else None, w[k + n] if k + n < len(w) else None))
    out = {}
    for words, found in spots.items():
        differ = lambda side: len({f[side] for f in found}) > 1 or None in {f[side] for f in found}
        if len({f[0] for f in found}) > 1 and differ(1) and differ(2):
            out[words] = (len(found), len({f[0] for f in found}), min(f[0] for f in found))
    return out


def maximal(docs, rows, width):
    """What the operator tells, by the words themselves."""
    words, out = defaultdict(list), {}
    for i, t, _ in rows:
        words[i].append(WORD.findall(t or ""))
    for r in repeats.maximal_repeats(docs, width).collect():
        found = {tuple(w[r["start"] : r["start"] + r["words"]]) for w in words[r["doc_id"]] if len(w) >= r["start"] + r["words"]}
        assert len(found) == 1 or len(words[r["doc_id"]]) > 1
        for f in found:
            assert len(f) == r["words"] >= width and f not in out
            out[f] = (r["places"], r["documents"], r["doc_id"])
    return out


@pytest.mark.parametrize("group", [120_000, 12, 3])
def test_maximal_repeats(documents, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(21)
    parts = [" ".join(f"p{rng.randint(0, 40)}" for _ in range(n)) for n in (9, 9, 10, 10, 11, 12, 5)]
    rows = [(i, " ".join(rng.choice([*parts, f"w{rng.randint(0, 99)}"]) for _ in range(rng.randint(1, 5))), "a") for i in range(60)]
    rows += [(100, parts[0], "a"), (101, f"{parts[0]} end", "a"), (102, " ".join(["z"] * 14), "a"), (103, " ".join(["z"] * 11), "a"), (104, None, "a"), (105, rows[0][1], "a")]
    want = plain_maximal(rows, 9, 99)
    assert maximal(documents(rows), rows, 9) == want and max(map(len, want)) > 25


@pytest.mark.parametrize("group, first", [(120_000, 64), (120_000, 8), (5, 64)])
def test_maximal_repeats_have_their_full_length(documents, monkeypatch, group, first):
    """Passages of 13 to 300 words, in two to six texts, some within others; one of them in most texts."""
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "FIRST", first)
    rng = random.Random(22)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    passages = [" ".join(word() for _ in range(n)) for n in (13, 14, 20, 33, 60, 64, 77, 128, 129, 300)]
    passages.append(" ".join([word(), *passages[9].split()[40:260], word()]))
    texts = [[word() for _ in range(rng.randint(0, 12))] for _ in range(30)]
    for k, p in enumerate(passages):
        for i in rng.sample(range(30), 2 + k % 5):
            texts[i] += [p, word()]
    for i in range(0, 30, 2):
        texts[i] = [passages[4], *texts[i]]
    rows = [(i, " ".join(t), "a") for i, t in enumerate(texts)]
    want = {}
    for p in {*passages, " ".join(passages[9].split()[40:260])}:
        w = tuple(p.split())
        found = [(i, k) for i, t, _ in rows for k in range(len(t.split()) - len(w) + 1) if tuple(t.split()[k : k + len(w)]) == w]
        if len({i for i, _ in found}) > 1:
            want[w] = (len(found), len({i for i, _ in found}), min(i for i, _ in found))
    got = maximal(documents(rows), rows, 13)
    assert got == want and max(map(len, got)) == 300


@pytest.mark.parametrize("operator", [repeats.remove_repeats, repeats.maximal_repeats, jaccard.jaccard_groups, jaccard.one_of_each])
def test_empty_tables(documents, operator):
    assert operator(documents([])).count() == 0


def test_one_anchor_in_most_texts_and_a_very_long_text(documents):
    """A footer in half of all texts, in many slices and buckets; and a text of 400,000 words that repeats itself and another."""
    rng = random.Random(13)
    footer = " ".join(f"f{k}" for k in range(20))
    rows = [(i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(30)) + (f" {footer}" if i % 2 else ""), "a") for i in range(2000)]
    rows.append((5000, " ".join([rows[0][1], *(f"v{k % 1000}" for k in range(400_000)), rows[1][1]]), "a"))
    got = repeats.remove_repeats(documents(rows).repartition(7)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == plain_removal(rows, 13)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(documents([rows[-1], (5001, rows[-1][1] + " end", "a")])).collect()}
    assert found[5000][1] == found[5001][1] == 5000 and found[5001][0] == found[5000][0] + 1


def test_fixity(spark):
    rng = random.Random(4)
    pages = [(i, f"http://h/{i}", f"<p>{rng.random()}</p>") for i in range(600)] + [(7, None, None), (7, None, None)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    assert fixity.audit(fixity.archived(d)).count() == 0
    kinds = {u: hashlib.sha256((u or "").encode()).digest()[0] for _, u, _ in pages}
    got = {(r["page_id"], r["url"]): (r["status"], r["digest"]) for r in fixity.audit(fixity.archived(d, fixity.decayed)).collect()}
    want = {(i, u): ("corrupt" if kinds[u] < 4 else "missing", hashlib.sha256(fixity.warc_record(i, u, (h or "").encode())).hexdigest()) for i, u, h in pages if kinds[u] < 6}
    assert got == want and want
    assert fixity.audit(fixity.archived(d.limit(0), fixity.decayed)).count() == 0


def test_fixity_reads_stored_files(spark):
    rng = random.Random(6)
    pages = [(i, f"http://h/{i}", f"<p>{rng.random()}</p>" * 9) for i in range(5000)]
    ours = fixity.archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1))
    theirs = fixity.replicated(ours, fixity.sound)
    assert fixity.audit(ours, theirs).count() == 0 and not set(ours.inputFiles()) & set(theirs.inputFiles())
    rows = [r.asDict() for r in theirs.collect()]
    at = {(r["archive"], r["node"]): r for r in rows}
    assert len({r["archive"] for r in rows}) == 2 and len(rows) == 313

    def again(node, change):
        row = at[(0, node)]
        records = [(p, u, fixity.unpacked(m)) for p, u, _, m in fixity.members(row)]
        row |= dict(zip(row, fixity.piece(0, node, row["offset"], change(records))))

    again(2, lambda x: x[:5] + [(-1, "http://new", fixity.warc_record(-1, "http://new", b"new"))] + x[5:])  # inserted
    again(3, lambda x: [x[1], x[0], *x[2:]])  # out of order
    again(5, lambda x: x[:4] + x[5:])  # lost
    rows = [r for r in rows if r is not at[(0, 7)]]  # a range is lost
    lone = dict(at[(0, 255)], archive=9, node=0)  # an archive that only the replica has
    changed = fixity.stored(spark.createDataFrame([tuple(r.values()) for r in [*rows, lone]], fixity.STORED).coalesce(1), "replica")
    member = list(fixity.members(at[(0, 100)]))[3][3]
    (file,) = [Path(f.removeprefix("file://")) for f in changed.inputFiles()]
    raw = bytearray(file.read_bytes())
    raw[raw.index(member) + len(member) // 2] ^= 1  # a bit rots in the stored file
    file.write_bytes(raw)
    (file.parent / f".{file.name}.crc").unlink()
    got = sorted((r["status"], r["page_id"], r["archive"]) for r in fixity.audit(ours, changed).collect())
    last = [p for p, *_ in fixity.members(at[(0, 255)])]
    want = [("corrupt", 1603, 0), ("extra", -1, 0), *(("extra", p, 9) for p in last), ("missing", 84, 0), *(("missing", p, 0) for p in range(112, 128))]
    assert [x for x in got if x[0] != "moved"] == sorted(want)
    assert [x[1] for x in got if x[0] == "moved"] in ([48], [49])


def test_ranges_that_a_replica_holds_more_than_once(spark):
    pages = [(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(100)]
    ours = fixity.archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1))
    rows = [r.asDict() for r in ours.collect()]
    at = {r["node"]: r for r in rows}

    def changed(node, change):
        row = at[node]
        return dict(row) | dict(zip(row, fixity.piece(0, node, row["offset"], change([(p, u, fixity.unpacked(m)) for p, u, _, m in fixity.members(row)]))))

    rot = lambda x: [(p, u, r[:-5] + b"!" + r[-4:] if p % 16 == 3 else r) for p, u, r in x]

    def found(replica):
        theirs = fixity.stored(spark.createDataFrame([tuple(r.values()) for r in replica], fixity.STORED), "replica")
        return sorted((r["status"], r["page_id"]) for r in fixity.audit(ours, theirs).collect())

    assert found([*rows, at[0]]) == [("extra", k) for k in range(16)]  # twice
    assert found([*rows, at[0], at[0], at[2]]) == sorted([("extra", k) for k in range(16)] * 2 + [("extra", k) for k in range(32, 48)])
    assert found([*rows, changed(1, rot)]) == [("extra", k) for k in range(16, 32)]  # twice, one of them corrupt
    both = [r for r in rows if r["node"] != 1] + [changed(1, rot), changed(1, lambda x: x[1:])]
    got = found(both)  # two copies, neither whole: one is compared, the other is surplus
    assert {s for s, _ in got} in ({"corrupt", "extra"}, {"missing", "extra"}) and sum(s == "extra" for s, _ in got) in (15, 16)
    assert found(rows) == [] and found([r for r in rows if r["node"] != 6]) == [("missing", k) for k in range(96, 100)]


def test_an_edit_without_a_target_changes_nothing(spark):
    log = [(1, None, "message", None, "user", "first"), (1, 2, "message", None, "assistant", "second"), (1, 3, "edit", None, "user", "EDITED"), (1, 4, "edit", 2, "user", "a"), (1, 4, "edit", 2, "user", "b")]
    turns = [r["segment"] for r in chat.format_conversations(spark.createDataFrame(log, chat.EVENTS)).orderBy("turn_no").collect()]
    assert turns == ["<s>[INST]first[/INST]", "[OUT]b</s>"]


@pytest.mark.parametrize("events", [chat.message_events, chat.turn_events])
def test_chat_round_trip(spark, events):
    rng = random.Random(9)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "\\", "[", "<", "é", "\n", "[ROLE]", "x"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool[1]", None]), rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))])) for c in (None, 1, 2, 3) for t in range(6)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash"))
    got = chat.digest_conversations(chat.format_conversations(events(d))).collect()
    for r in got:
        turns = [(a or "", b or "") for c, _, a, b in rows if c == r["conv_id"]]
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (6, hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == 4
    assert all(chat.unescape(chat.escape(x)) == x for x in ("".join(rng.choice(parts) for _ in range(9)) for _ in range(300)))


def plain_fold(log):
    """(role, text) of each message, by the rules, from a log in order."""
    edits = {}
    for seq, kind, target, _, text in log:
        if kind == "edit":
            edits[target] = text or ""
    out = []
    for seq, kind, _, role, text in log:
        if kind == "edit":
            continue
        role, text = role or "", text or ""
        if kind == "delta" and out and role in ("", out[-1][0]):
            out[-1][1] += text
            out[-1][2] = edits.get(seq, out[-1][2])
        elif kind == "regenerate" and out:
            out[-1] = [role or out[-1][0], text, edits.get(seq)]
        else:
            out.append([role, text, edits.get(seq)])
    return [(r, t if e is None else e) for r, t, e in out]


def test_chat_any_log(spark):
    rng, rows, logs = random.Random(12), [], {}
    for conv in [None, *range(40)]:
        logs[conv] = [(k, rng.choice(["message", "delta", "delta", "regenerate", "edit"]), rng.randint(-1, 12), rng.choice(["user", "assistant", None]), rng.choice(["a", "b<", "", None])) for k in range(12)]
        rows += [(conv, s, kind, target if kind == "edit" else None, role, text) for s, kind, target, role, text in logs[conv]]
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, chat.EVENTS).repartition(5)
    got = defaultdict(list)
    for r in chat.format_conversations(events).orderBy("conv_id", "turn_no").collect():
        got[r["conv_id"]].append(r["segment"])
    assert {c: [chat.render_turn(*m)[0] for m in plain_fold(log)] for c, log in logs.items() if plain_fold(log)} == got


def test_chat_long_text(spark):
    text = "<[x" * 1_000_000
    d = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    r = chat.digest_conversations(chat.format_conversations(chat.turn_events(d))).first()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (1, 3_000_000, hashlib.sha256(text.encode()).hexdigest())


def test_chat_events_fold(spark):
    log = [(1, 3, "delta", None, None, "lo"), (1, 1, "message", None, "user", "hi"), (1, 2, "message", None, "assistant", "hel"), (1, 4, "regenerate", None, None, "bye"), (1, 5, "delta", None, None, "!"), (1, 6, "edit", 1, None, "hey"), (1, 7, "edit", 1, None, "HEY")]
    got = chat.format_conversations(spark.createDataFrame(log, chat.EVENTS)).orderBy("turn_no").collect()
    assert [r["segment"] for r in got] == ["<s>[INST]HEY[/INST]", "[OUT]bye!</s>"]
    log = [(1, 1, "message", None, "user", "hi"), (1, 2, "delta", None, "assistant", "hel"), (1, 3, "delta", None, "assistant", "lo")]
    got = chat.format_conversations(spark.createDataFrame(log, chat.EVENTS)).orderBy("turn_no").collect()
    assert [r["segment"] for r in got] == ["<s>[INST]hi[/INST]", "[OUT]hello</s>"]
    assert chat.digest_conversations(chat.format_conversations(spark.createDataFrame([], chat.EVENTS))).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 12)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] + [1.0] * 11), (1003, [None] + [1.0] * 11), (1004, []), (None, [1.0] * 12)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("curve", F.lit("clash"))
    got = defaultdict(list)
    for r in ann.nearest(d, F.col("vec_id") % 20 == 0, window=32, query_block=7).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    wide = x.astype(float)
    for q in range(0, 400, 20):
        score = np.zeros(400)
        for k in range(12):
            score += wide[q, k] * wide[:, k]
        score[q] = -np.inf
        order = np.lexsort((np.arange(400), -score))[:20]
        assert got[q] == [(int(i), float(score[i])) for i in order]
    assert set(got) == set(range(0, 400, 20))
    assert ann.nearest(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_curves_alone_on_vectors_with_structure(spark):
    """On clustered vectors the windows alone reach 0.9, and the second pass leaves nearly no pair of blocks."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((100, 32))
    x = (centres[rng.integers(0, 100, 6000)] + 0.05 * rng.standard_normal((6000, 32))).astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    wide = x.astype(float)
    score = wide[::20] @ wide.T
    score[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    want = [set(np.argsort(-s)[:20].tolist()) for s in score]
    for whole, least in ((False, 0.9), (True, 1.0)):
        got = defaultdict(set)
        for r in ann.nearest(d, F.col("vec_id") % 20 == 0, window=512, whole=whole).collect():
            got[r["query_id"]].add(r["vec_id"])
        assert sum(len(got[20 * i] & w) for i, w in enumerate(want)) >= least * 6000


def test_rows_that_share_a_vec_id(spark):
    d = spark.createDataFrame([(0, [1.0, 1.0]), (1, [3.0, 0.0]), (1, [2.0, 9.0]), (1, [2.0, 9.0]), (2, [5.0, 0.0]), (2, [5.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(d, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 11.0), (0, 2, 2, 5.0)]


def test_hilbert_neighbours_are_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    order = np.argsort(ann.hilbert_key(cells, 3))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_only_blocks_that_may_hold_a_neighbour_meet(spark, monkeypatch):
    """On clustered vectors fewer than half of the pairs of blocks stay, each true neighbour's among them."""
    monkeypatch.setattr(ann, "FAN", 4)
    rng = np.random.default_rng(17)
    centres = 8 * rng.normal(size=(60, 12))
    x = (centres[np.arange(6000) % 60] + 0.05 * rng.normal(size=(6000, 12))).astype(np.float32)
    d = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    kept, paired = [], ann.paired
    monkeypatch.setattr(ann, "paired", lambda blocks, asking: kept.append((blocks.count(), asking.count(), paired(blocks, asking))) or kept[-1][2])
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(d, F.col("vec_id") % 20 == 0, window=64, query_block=16).collect()}
    n, q, pairs = kept[0]
    found = pairs.count()
    assert n >= 94 and q >= 18 and found == pairs.distinct().count() and found < 0.5 * n * q
    y = x.astype(np.float64)
    for query in range(0, 6000, 400):
        score = y @ y[query]
        score[query] = -np.inf
        order = np.lexsort((np.arange(6000), -score))[:20]
        assert [got[query, k + 1][0] for k in range(20)] == order.tolist()


def test_a_list_that_most_texts_are_in_needs_no_bucket(documents, monkeypatch):
    """Texts of few shingles that share all but some: one list has them all. What a bucket gets of it is bounded by tasks' buffers."""
    monkeypatch.setattr(jaccard, "HELD_PARTS", 300)
    rng = random.Random(31)
    shared = " ".join(f"s{k}" for k in range(60))
    rows = [(i, f"{shared} " + " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([1, 2, 40]))), "a") for i in range(700)]
    rows += [(1000 + i, " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(50)), "a") for i in range(50)] + [(2000, None, "a"), (2001, "one two", "a"), (2002, "one two", "b")]
    d = documents(rows)
    keyed = jaccard.with_keys(d)
    parts = jaccard.map_batches(keyed.select("id", "k1", "text").coalesce(1), jaccard.part_rows(3, 90, 8), jaccard.PARTS).collect()
    entries = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in parts if r["kind"] == jaccard.LISTS])
    known = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in parts if r["kind"] == jaccard.KNOWN])
    most, rounds = Counter(entries.tolist()).most_common(1)[0][1], -(-(len(entries) + len(known)) // 300)
    assert most <= (jaccard.COMMON + 1) * rounds and Counter(known.tolist()).most_common(1)[0][1] > 300
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(d).collect()}
    sets = {i: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if (w := WORD.findall((t or "").lower())) else set() for i, t, _ in rows}
    least = {i: i for i in sets}
    for _ in range(3):
        for a in sets:
            for b in sets:
                if a != b and sets[a] and sets[b] and least[a] != least[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    assert got == {i: (len(sets[i]), least[i]) for i in sets}
