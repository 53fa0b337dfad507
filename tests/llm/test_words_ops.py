"""Quality rules, license scan, packing, mix, personal data against plain versions on hand-made documents."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticelake.llm import license, mixing, packing, pii, quality, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
HARD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "a b c a b c a b c", "a"), (4, "a b c a b c a b c", "a"), (None, "x  y z\nx y z\n\nx  y z", "b"), (5, "é é \x1c ü", None), (6, "word " * 3000, "a")]


def test_quality_base(documents):
    got = quality.quality_rules(documents(HARD)).collect()
    assert len(got) == len(HARD)
    for r in got:
        text = next(t for i, t, s in HARD if i == r["doc_id"]) or ""
        words = WORD.findall(text)
        threes = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often, covered = Counter(threes), set()
        for k, t in enumerate(threes):
            if often[t] > 1:
                covered |= {k, k + 1, k + 2}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(covered))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r["base_failed"] and r["kept"])


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_frequent_lines_leave_and_copies_stay(documents):
    rng = random.Random(1)
    footer = "Subscribe To Our News 2024 today please"
    rows = [(i, prose(rng, 60) + f"\n{footer}", "a") for i in range(60)]
    rows += [(100 + i, "\n".join([footer] * 1 + [prose(rng, 20)] + ["Menu home about contact page one two"] * 1 + [footer.upper()] * 12), "a") for i in range(3)]
    copy = "\n".join(prose(rng, 30) for _ in range(3))
    rows += [(200 + i, copy, "a") for i in range(80)]
    found = {r["doc_id"]: r for r in quality.quality_rules(documents(rows)).collect()}
    assert all(found[i]["kept"] and found[i]["n_removed_words"] == 7 for i in range(60))
    assert all(found[200 + i]["kept"] and not found[200 + i]["n_removed_words"] for i in range(80))  # one document, many copies
    assert not any(found[100 + i]["kept"] for i in range(3))
    left = quality.apply_quality(documents(rows), quality.quality_rules(documents(rows)))
    assert left.columns == documents(rows).columns
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert footer not in texts[0] and texts[200] == copy and 100 not in texts


def test_different_documents_that_share_most_lines_count_each(documents):
    rng = random.Random(2)
    shared = "\n".join(prose(rng, 20) for _ in range(5))
    rows = [(i, f"{shared}\n{prose(rng, 30)}", "a") for i in range(200)]
    few = prose(rng, 12)
    rows += [(1000 + i, f"{few}\n{prose(rng, 60)}", "b") for i in range(20)]  # at the limit, not above
    found = {r["doc_id"]: r for r in quality.quality_rules(documents(rows)).collect()}
    assert all(found[i]["n_removed_words"] == 100 and not found[i]["kept"] and not found[i]["base_failed"] for i in range(200))
    assert all(found[1000 + i]["n_removed_words"] == 0 and found[1000 + i]["kept"] for i in range(20))


def test_license(documents):
    long = "word " * 100_000
    rows = HARD + [(10, "Released UNDER the MIT License. Apache-License, version 2.0 cc-by-nc", "a"), (11, "GNU General Public License, version 3", "a"), (12, "gnu general public license as published by the free software foundation, either version 3; all rights reserved", None), (13, long + "under the mit license " + long, "a")]
    got = {r["doc_id"]: r for r in license.license_scan(documents(rows)).collect()}
    assert (got[10]["n_words"], got[10]["n_base"], got[10]["first_word"], got[10]["last_word"], got[10]["base_labels"]) == (13, 3, 1, 10, "apache-2,cc-by-nc,mit")
    assert got[11]["labels"] == "gpl-3" and got[12]["labels"] == "gpl-3" and got[12]["n_base"] == 0 and got[11]["score"] == 1.0
    assert got[1]["n_words"] == 0 and got[1]["labels"] == "" and got[1]["first_word"] is None
    assert (got[13]["n_base"], got[13]["first_word"], got[13]["labels"]) == (1, 100_000, "mit")


def filled(markup, rng):
    """A text that the template accepts: options taken at random, words for what may vary."""

    def of(elements):
        out = []
        for e in elements:
            if e[0] == "word":
                out.append(e[1])
            elif e[0] == "any":
                out += [f"z{rng.randint(0, 99)}" for _ in range(rng.randint(e[1], e[2]))]
            elif rng.random() < 0.5:
                out += of(e[1])
        return out

    return of(license.parsed("x", markup))


def test_whole_license_texts(documents):
    """Each template's texts get its label, with any mandatory word changed they don't, whatever the options; in any place."""
    rng, rows, want = random.Random(4), [], {}
    for label, markup in license.read_templates().items():
        for _ in range(3):
            words = filled(markup, rng)
            rows.append((len(rows), "Intro " + " ".join(words).upper() + ". The end", "a"))
            want[rows[-1][0]] = (label, True)
        top = [e[1] for e in license.parsed(label, markup) if e[0] == "word"]
        for at in {0, len(top) // 2, len(top) - 1}:
            seen, words = 0, []
            for e in license.parsed(label, markup):
                if e[0] == "word":
                    words.append("altered" if seen == at else e[1])
                    seen += 1
                elif e[0] == "any":
                    words += ["zz"] * max(1, e[1])
            rows.append((len(rows), " ".join(words), "a"))
            want[rows[-1][0]] = (label, False)
    scanned = license.license_scan(documents(rows)).collect()
    got = {r["doc_id"]: {p["label"] for p in r["places"]} for r in scanned}
    assert all(set(filter(None, r["labels"].split(","))) == {license.license_of(x) for x in got[r["doc_id"]]} for r in scanned)
    assert license.license_of("lgpl-2.1-notice") == "lgpl-2.1" and license.license_of("mit") == "mit"
    assert len(want) > 100 and not [(i, label, there, got[i], rows[i]) for i, (label, there) in want.items() if (label in got[i]) != there]


def test_template_markup():
    a = license.Automaton("x", "<<beginOptional>>a <<beginOptional>>very <<endOptional>>short title<<endOptional>> to the <<beginOptional>>fullest <<endOptional>>extent <<var;words=0-2>> law")
    for text, span in (("to the extent law", (0, 4)), ("to the fullest extent of any law", (0, 7)), ("to the extent of any other law", None), ("to the fullest law", None), ("x a short title to the extent law y", (1, 8)), ("a very short title to the extent law", (0, 8)), ("very short title to the extent law", (3, 7))):
        words = text.split()
        found = [m for i, w in enumerate(words) if w == a.anchor_word and (m := a.match(lambda i: words[i], i, 0, len(words)))]
        assert found == ([span] if span else []), text
    for wrong in ("<<beginOptional>>only<<endOptional>>", "<<beginOptional>>a b", "a <<endOptional>>", "<<var;words=1-2>>"):
        with pytest.raises(ValueError):
            license.Automaton("y", wrong)


def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_packing(documents):
    path, plain = tokenizer()
    rng = random.Random(3)
    rows = HARD + [(20 + i, prose(rng, rng.randint(0, 60)) + " it's <|endoftext|> É.", "a") for i in range(60)]
    found = packing.pack_documents(documents(rows), path, capacity=256, keep_ids=True).collect()
    whole = defaultdict(list)
    for i, t, _ in rows:
        whole[i].append(plain.encode(t or "", add_special_tokens=False).ids + [1])
    for r in found:
        ids = np.array(whole[r["doc_id"]][0][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert zlib.crc32(ids) == r["ids_crc32"] and bytes(r["ids"]) == ids
    assert sum(r["length"] for r in found) == sum(len(x) for w in whole.values() for x in w)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= math.ceil(sum(r["length"] for r in found) / 256) + 1


def test_tokenizers_that_reach_across_white_space(documents):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    assert tokens.WordTokenizer(P.path("word_bpe_49k.json")).by_word
    path = P.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = [(1, "Hello world, it's  two\n lines", "a"), (2, None, "a"), (3, " x", "a")]
    for r in packing.pack_documents(documents(rows), path, capacity=64, keep_ids=True).collect():
        ids = plain.encode(rows[r["doc_id"] - 1][1] or "", add_special_tokens=False).ids + [1]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids


def test_sum_of_squares_places_by_the_rule():
    rng, s = random.Random(5), packing.SumOfSquares(20)
    gaps = []
    for _ in range(300):
        size = rng.randint(1, 20)
        n = Counter(gaps)
        fits = sorted({g for g in gaps if g >= size})

        def squares(g):
            after = Counter(n)
            after[g] -= 1
            if g > size:
                after[g - size] += 1
            return sum(v * v for v in after.values())

        want = min(fits, key=lambda g: (squares(g), g)) if fits else 20
        _, offset = s.place(size)
        assert 20 - offset == want
        if fits:
            gaps.remove(want)
        if want > size:
            gaps.append(want - size)


def test_mix(documents):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(1, 80)), rng.choice(["a", "b", "b", "b", None])) for i in range(400)] + [(i, t, "c") for i, t, _ in HARD]
    got = mixing.mix_sources(documents(rows), seed=3).collect()
    again = mixing.mix_sources(documents(rows), seed=3).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    order = sorted(k for k in size if k is not None) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    want, left, total = {}, set(order), 1.5 * sum(size.values())
    while True:
        rest, w = total - sum(want.values()), sum(weight[k] for k in left)
        over = {k for k in left if rest * weight[k] / w > 2 * size[k]}
        if not over:
            want |= {k: rest * weight[k] / w for k in left}
            break
        want |= {k: 2.0 * size[k] for k in over}
        left -= over
    for k in order:
        largest = max(r["size"] for r in got if r["source"] == k)
        assert target[k] == pytest.approx(want[k]) and abs(taken[k] - want[k]) <= largest / 2


@pytest.mark.parametrize("rows", [
    [(None, f"w{i} b c d", "a") for i in range(600)],  # no ids
    [(7, f"w{i} b c d", "a") for i in range(600)],  # one id
    [(None, "all the same words", "a")] * 600,  # equal rows
], ids=["null ids", "one id", "equal"])
def test_rows_without_an_id_of_their_own_are_drawn_at_random(documents, rows):
    """Of 600 rows of one size half a copy more is taken on average, evenly over the file, and as often however the rows are split."""
    got = mixing.mix_sources(documents(rows).coalesce(1).withColumn("doc_id", F.col("doc_id"))).collect()
    copies = [r["copies"] for r in got]
    extra = sum(c == 2 for c in copies)
    assert sum(copies) == 900 and set(copies) == {1, 2} and extra == 300
    if rows[0][1] != rows[1][1]:  # which of equal rows is taken shows nowhere
        where = {r["text_key"]: k for k, r in enumerate(documents(rows).coalesce(1).select(F.xxhash64("text").alias("text_key")).collect())}
        thirds = Counter(where[r["text_key"]] // 200 for r in got if r["copies"] == 2)
        assert all(70 < thirds[k] < 130 for k in range(3))
    other = mixing.mix_sources(documents(rows).repartition(3)).collect()
    assert Counter((r["text_key"], r["copies"]) for r in other) == Counter((r["text_key"], r["copies"]) for r in got)


def test_chances_differ_by_size_and_come_to_what_is_missing(spark):
    rng = random.Random(8)
    words = {("a", k): rng.randint(1, 10**6) for k in range(1, 15)} | {(None, k): rng.randint(1, 100) for k in range(1, 6)} | {("c", 1): 0, ("d", 3): 40}
    size = Counter()
    for (source, _), n in words.items():
        size[source] += n
    target = {"a": 1.37 * size["a"], None: 0.02 * size[None], "c": 0.0, "d": 80.0}
    rows = spark.createDataFrame([(*k, n) for k, n in words.items()], "source string, class int, words long")
    targets = spark.createDataFrame([(s, n, 1.0, target[s]) for s, n in size.items()], "source string, source_size long, weight double, target double")
    got = mixing.inclusion(rows, targets, 0.25).collect()
    reached, chances = Counter(), defaultdict(dict)
    for r in got:
        reached[r["source"]] += (r["certain"] + r["p"]) * words[r["source"], r["class"]]
        chances[r["source"]][r["class"]] = r["p"] + r["certain"]
        assert 0 <= r["p"] < 1
    assert all(reached[s] == pytest.approx(target[s]) for s in size) and len(got) == len(words)
    assert all(chances["a"][k] < chances["a"][k + 1] or chances["a"][k] == chances["a"][k + 1] == 2 for k in range(1, 14))


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_personal_data(documents):
    rng = random.Random(11)
    parts = ["a@b.c", "@", ".", "1.2.3.4", "256.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", "+49 30 1234 5678 9012 34", " ", "-", "é", "\n", "_", "12", "\u0001", "+", "(", "9", "a.b@c.d.e@f.g"]
    rows = HARD + [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))), "a") for i in range(400)] + [(1000, "1" * 20000, "a"), (1001, "a" * 20000, "a"), (1002, "+1 " * 5000, "a")]
    texts = {i: t or "" for i, t, _ in rows}
    for r in pii.personal_data(documents(rows)).collect():
        want = plain_spans(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x[1] for x in want) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{pii.NAMES[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()


def test_account_numbers_and_masks(documents):
    d = documents([(1, "IBAN GB82 WEST 1234 5698 7654 32 or GB82 WEST 1234 5698 7654 33; jo@x.org é +1 (555) 123-4567", "a"), (2, None, "a"), (3, "", "a"), (4, "\u0001 same", "a")])
    got = {r["doc_id"]: r for r in pii.personal_data(d).collect()}
    assert (got[1]["spans"], got[1]["scores"], got[1]["n_spans"]) == ("iban:5:32,email:65:73,phone:76:93", "100,70,60", 3) and got[2]["spans"] == ""
    masked = pii.mask_documents(d)
    assert masked.columns == d.columns
    assert {r["doc_id"]: (r["text"], r["spans"]) for r in masked.collect()} == {1: ("IBAN <IBAN> or GB82 WEST 1234 5698 7654 33; <EMAIL> é <PHONE>", "clash"), 2: (None, "clash"), 3: ("", "clash"), 4: ("\u0001 same", "clash")}


def test_groups_that_follow_account_numbers(documents):
    rows = [(1, "ES91 2100 0418 4502 0005 1332 BIC CAIXESBB", "a"), (2, "AT61 1904 3002 3457 3201 2024", "a"), (3, "ES91 2100 0418 4502 0005 1332 GB82 WEST 1234 5698 7654 32 2024", "a"), (4, "AT61 1904 3002 3457 3202 2024", "a"), (5, "GB82WEST12345698765432 XX", "a")]
    got = {r["doc_id"]: r["text"] for r in pii.mask_documents(documents(rows)).collect()}
    assert got == {1: "<IBAN> BIC CAIXESBB", 2: "<IBAN> 2024", 3: "<IBAN> <IBAN> 2024", 4: rows[3][1], 5: "<IBAN> XX"}
    spans = {r["doc_id"]: r["spans"] for r in pii.personal_data(documents(rows)).collect()}
    assert spans[2] == "iban:0:24" and spans[1] == "iban:0:29" and spans[4] == ""


def test_context_decides_where_the_form_says_little(documents):
    hexes = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    pairs = [
        (f'token = "{hexes}"', f'commit "{hexes}"', f'token = "<SECRET>"'), ("SSN 078-05-1120 of", "part 078-05-1120 of", "SSN <SSN> of"), ("dni 12345678Z", "ref 12345678Z", "dni <DNI>"),
        ("num\u00e9ro 185057800608491", "code 185057800608491", "num\u00e9ro <NIR>"),
    ]
    rows = [(2 * k + j, t, "a") for k, p in enumerate(pairs) for j, t in enumerate(p[:2])]
    got = {r["doc_id"]: r for r in pii.personal_data(documents(rows)).collect()}
    texts = {r["doc_id"]: r["text"] for r in pii.mask_documents(documents(rows)).collect()}
    for k, (_, without, masked) in enumerate(pairs):
        assert got[2 * k]["n_spans"] == 1 and got[2 * k + 1]["n_spans"] == 0 and texts[2 * k] == masked and texts[2 * k + 1] == without
    wrong = [(1, "ssn 000-12-3456", "a"), (2, "dni 12345678A", "a"), (3, "num\u00e9ro 185057800608492", "a"), (4, "token " + "a" * 40, "a"), (5, "Password: hunter2 x", "a")]
    assert {r["doc_id"]: r["spans"] for r in pii.personal_data(documents(wrong)).collect()} == {1: "", 2: "", 3: "", 4: "", 5: "password:0:17"}


def test_many_spans_in_one_text(documents):
    n = 200_000
    text = " ".join(f"a{i}@b.org" for i in range(n))
    d = documents([(1, text, "a")])
    r = pii.personal_data(d).select("n_email", "base_sha256").first()
    assert r["n_email"] == n and r["base_sha256"] == hashlib.sha256(",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"\S+", text)).encode()).hexdigest()
    assert pii.mask_documents(d).first()["text"] == " ".join(["<EMAIL>"] * n)


@pytest.mark.parametrize("operator", [quality.quality_rules, license.license_scan, mixing.mix_sources, pii.personal_data, lambda d: packing.pack_documents(d, tokenizer()[0])])
def test_empty_tables(documents, operator):
    assert operator(documents([])).count() == 0
