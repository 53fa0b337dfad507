"""Quality rules by brute force; each stage of the pipeline against a plain version, on documents with nulls, empty texts, repeats,
ties and columns whose names the stages use inside."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from noticelake.llm import quality
from noticelake.llm.common import Words

from .test_search_ops import WORD, plain_groups
from .test_words_ops import prose, tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, removed_lines string, __removed string, copies int, row string, bucket long, class string, sequence_id string, spans string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", "x", 7, "x", 7, "x", "x", "x") for i, t, s in rows], COLUMNS)


def normal(line):
    return b" ".join(line.encode().translate(quality.LINE_TABLE).split())


def plain_quality(rows, least=20, share=0.02, depleted=0.5):
    """(frequent lines by host, verdict and words lost by row)."""
    texts = defaultdict(set)
    for _, t, s in rows:
        texts[s].add(t)
    frequent = {}
    for s, own in texts.items():
        count = Counter(x for t in own for x in {normal(line) for line in (t or "").split("\n")} - {b""})
        frequent[s] = {x for x, n in count.items() if n > max(least, share * len(own))}
    out = []
    for _, t, s in rows:
        words = WORD.findall(t or "")
        threes = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often, covered = Counter(threes), set()
        for k, x in enumerate(threes):
            covered |= {k, k + 1, k + 2} if often[x] > 1 else set()
        lost = sum(len(normal(line).split()) for line in (t or "").split("\n") if normal(line) in frequent[s])
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        out.append((lost, not failed and lost <= depleted * len(words)))
    return frequent, out


@pytest.mark.parametrize("seed", range(4))
def test_line_frequency_by_brute_force(documents, seed):
    """Hosts whose documents share 30 to 99 % of their words, with copies; limits met exactly and passed by one."""
    rng, rows = random.Random(seed), []
    for host, part in enumerate((30, 49, 51, 60, 80, 90, 95, 99)):
        shared = [prose(rng, 10) for _ in range(max(1, part // 10))]
        for _ in range(rng.choice([20, 21, 22, 60])):
            own = prose(rng, max(1, 10 * len(shared) * (100 - part) // part))
            lines = [*shared, own] if rng.random() < 0.9 else [own, prose(rng, 60)]
            rng.shuffle(lines)
            rows.append((len(rows), "\n".join(lines), f"h{host}"))
        rows += [(len(rows) + k, rows[-1][1], f"h{host}") for k in range(30)]  # copies count once
    _, want = plain_quality(rows)
    got = {r["doc_id"]: (r["n_removed_words"], r["kept"]) for r in quality.quality_rules(documents(rows)).collect()}
    assert got == {i: w for (i, _, _), w in zip(rows, want)}
    assert {k for _, k in want} == {True, False} and any(n for n, _ in want)


def plain_mix(rows, seed=7):
    """How often the mix takes each row."""
    sizes = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total = Counter()
    for (_, _, s), n in zip(rows, sizes):
        total[s] += n
    order = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight, target, left, budget = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, list(order), 1.5 * sum(sizes)
    while left:
        level = (budget - sum(target.values())) / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * level > 2 * total[s]]
        if not over:
            target |= {s: weight[s] * level for s in left}
            break
        target |= {s: 2.0 * total[s] for s in over}
        left = [s for s in left if s not in over]
    copies, equal, draws = [0] * len(rows), Counter(), []
    drawn = lambda *parts: int(hashlib.md5(":".join("null" if x is None else str(x) for x in parts).encode()).hexdigest()[:13], 16)
    for i, t, s in rows:
        first, n = drawn(seed, i, s, None if t is None else hashlib.md5(t.encode()).hexdigest()), equal[i, t, s]
        equal[i, t, s] += 1
        draws.append(drawn(first, n) if n else first)
    for s in order:
        own = [k for k, r in enumerate(rows) if r[2] == s]
        certain = math.floor(target[s] / total[s] + 1e-12) if total[s] else 0
        missing = target[s] - certain * total[s]
        kind = {k: max(1, sizes[k].bit_length()) for k in own}
        words = Counter()
        for k in own:
            words[kind[k]] += sizes[k]
        chance = 2 ** 0.25
        full: set[int] = set()
        while len(full) < len(words):
            rest = sum(n * chance**c for c, n in words.items() if c not in full)
            level = (missing - sum(words[c] for c in full)) / rest if rest else 0
            top = max(c for c in words if c not in full)
            if level * chance**top <= 1 + 1e-12:
                break
            full.add(top)
        p = {c: 0.0 if c in full else max(0.0, level * chance**c) for c in words}
        full |= {c for c in words if p[c] >= 1 - 1e-12}
        missing -= sum(words[c] for c in full)
        drawn = []
        for k in own:
            copies[k] = certain + (kind[k] in full)
            if kind[k] not in full and p[kind[k]] > 1e-12:
                u = (draws[k] + 0.5) / 2**52
                odds = (u / (1 - u)) / (p[kind[k]] / (1 - p[kind[k]]))
                drawn.append((odds / (1 + odds), rows[k][0] is not None, rows[k][0] or 0, sizes[k], k))
        reached = 0
        drawn.sort()
        for at, (_, _, _, n, k) in enumerate(drawn):
            if reached + n > missing:
                short = missing - reached
                near = min(((abs(short - x[3]), *x) for x in drawn[at:] if abs(short - x[3]) < short), default=None)
                if near:
                    copies[near[-1]] += 1
                break
            reached += n
            copies[k] += 1
    return copies


PII = ("write to jo.doe@example.org", "write to <EMAIL>"), ("host 10.20.30.40 is up", "host <IP> is up"), ("card 4111 1111 1111 1111 ok", "card <CARD> ok"), ("call +1 (555) 123-4567 now", "call <PHONE> now"), ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', 'token = "<SECRET>"')


def test_stages(spark, tmp_path):
    tokenizer()
    import corpus_pipeline

    rng = random.Random(31)
    footer = "Subscribe to our news for 2024 now please"
    rows = [(k, f"{prose(rng, rng.randint(50, 160))} É.\n{footer if k % 2 else prose(rng, 5)}", rng.choice(["a", "a", "b", None])) for k in range(90)]
    rows += [(200 + k, rows[3 * k][1].replace("\n", f" {prose(rng, 1)}\n"), rows[3 * k][2]) for k in range(10)]  # near copies
    rows += [(300 + k, f"{prose(rng, 70)}\n{PII[k % len(PII)][0]}", "b") for k in range(10)]
    rows += [(400, None, "a"), (401, "", "a"), (402, " \n", None), (403, "few words", "b"), (None, prose(rng, 80), "a"), rows[5], rows[5], (None, rows[7][1], rows[7][2]), (500, "\n".join([footer] * 12 + [prose(rng, 12)]), "a")]
    stages = [f for _, f in corpus_pipeline.STAGES]
    columns = table(spark, rows).columns
    now = table(spark, rows)

    def after(k, stage):
        stage(spark, now, "").write.parquet(str(tmp_path / str(k)))
        return spark.read.parquet(str(tmp_path / str(k)))

    def told(df):
        assert df.columns == columns and df.filter("n_chars <> char_length(text) OR removed_lines <> 'x'").count() == 0
        return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]

    frequent, verdicts = plain_quality(rows)
    assert any(frequent.values())
    want = [(i, "\n".join(x for x in t.split("\n") if normal(x) not in frequent[s]), s) for (i, t, s), (_, kept) in zip(rows, verdicts) if kept]
    now = after(0, stages[0])
    assert Counter(told(now)) == Counter(want) and len(want) < len(rows)

    rows, named = told(now), {}
    for i, t, s in rows:
        named.setdefault((i, t), (i, t, s))
    once = list(named.values())
    groups = plain_groups([(k, t, s) for k, (_, t, s) in enumerate(once)], 5, 80)
    first = defaultdict(list)
    for k, (i, _, _) in enumerate(once):
        first[groups[k][1]].append((i is None, i or 0, k))
    want = [once[min(g)[2]] for g in first.values()]
    now = after(1, stages[1])
    assert Counter((i, t) for i, t, _ in told(now)) == Counter((i, t) for i, t, _ in want) and len(want) < len(once)

    rows = told(now)
    masks = dict(PII)
    want = []
    for i, t, s in rows:
        for raw, mask in masks.items():
            t = t.replace(raw, mask)
        want.append((i, t, s))
    now = after(2, stages[2])
    assert Counter(told(now)) == Counter(want) != Counter(rows)

    rows = told(now)
    want = Counter()
    for r, n in zip(rows, plain_mix(rows)):
        want[r] += n
    now = after(3, stages[3])
    assert Counter(told(now)) == +want

    path, plain = tokenizer()
    tokens = sum(len(plain.encode(t, add_special_tokens=False).ids) + 1 for _, t, _ in told(now))
    packed = stages[4](spark, now, "").collect()
    assert sum(r["length"] for r in packed) == tokens and len({r["sequence_id"] for r in packed}) <= math.ceil(tokens / 4096) + 1
    empty = now.limit(0)
    assert all(stage(spark, empty, "").count() == 0 for stage in stages)


def test_words_of_bytes():
    import pyarrow as pa

    w = Words(pa.array([None, "", "a  b\tc", " é "]))
    assert w.counts.tolist() == [0, 0, 3, 1]
