import random
import re
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmith.llm import leakage, mojibake, neardup, packing, pii, terms, topn
from corpusmith.llm.common import one_per_id
from corpusmith.llm.shingles import hashed_words, words_of

WORDS = [f"w{i}" for i in range(400)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0, "a", "b") for i, t in rows], "doc_id string, text string, id int, t string, h string")


# terms
def by_hand(rows):
    occ, rec, holders = Counter(), Counter(), 0
    for t in dict(rows).values():
        found = re.findall(r"[^\W\d_]+", (t or "").lower())
        occ.update(found)
        rec.update(set(found))
        holders += bool(found)
    return {w: (occ[w], rec[w], "rare" if rec[w] < 3 else "common" if rec[w] > holders / 2 else None) for w in occ}


@pytest.mark.parametrize(("burst", "flush"), [(2048, 400_000), (2, 5)])
def test_terms(spark, burst, flush):
    rng = random.Random(1)
    rows = [(f"d{i}", " ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 12)))) for i in range(200)] + [("n", None), ("b", "  "), ("x", "ÀÉ the-END 12 ﬁ_a")]
    got = terms.term_counts(docs(spark, rows + rows[:20] + [(None, "zzz")]), "doc_id", "text", burst=burst, flush=flush)
    assert {r.term: (r.occurrences, r.records, r.mark) for r in got.collect()} == by_hand(rows)


def test_terms_of_nothing(spark):
    assert terms.term_counts(docs(spark, []), "doc_id", "text").count() == 0
    assert terms.term_counts(docs(spark, [("a", None)]), "doc_id", "text").count() == 0


def test_terms_of_a_long_text(spark):
    got = {r.term: r.occurrences for r in terms.term_counts(docs(spark, [("a", "long " * 200_000 + "tail")]), "doc_id", "text").collect()}
    assert got == {"long": 200_000, "tail": 1}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), max_size=60), st.integers(1, 4))
def test_trie_keeps_counts(words, limit):
    trie = terms.BurstTrie(limit)
    for w in words:
        trie.add(w, 1, 1)
    assert Counter(words) == {p + s: e[0] for p, leaf in trie.subtrees() for s, e in leaf.items()}


# groups
def test_top_n(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), f"i{rng.randint(0, 300)}", rng.choice([0.1, 0.5, 0.9, 1.0, 1.5, -1.0, float("nan"), None])) for _ in range(2000)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "topic string, doc_id string, p double, g int, i int, s int")
    best = {}
    for g, i, p in rows:
        if g is not None and p is not None and p == p and 0 <= p <= 1:
            best[g, i] = max(p, best.get((g, i), 0))
    want = {(g, *x) for g in {g for g, _ in best} for n, x in enumerate(sorted((-p, i) for (h, i), p in best.items() if h == g)[:7]) for x in [(x[1], n + 1)]}
    got = topn.top_n_per_group(df, "topic", "p", "doc_id", 7, 0, 1).collect()
    assert {(r.topic, r.doc_id, r.position) for r in got} == want
    assert topn.top_n_per_group(df.limit(0), "topic", "p", "doc_id", 7).count() == 0


# near-duplicates
def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return words


def shingles(t, n):
    w = re.findall("[a-z0-9]+", (t or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_near_duplicates(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        base = [rng.choice(WORDS) for _ in range(60)]
        rows.append((f"a{i}", " ".join(base)))
        rows.append((f"b{i}", " ".join(edited(rng, base, rng.randint(1, 8)))))
    rows += [("c0", rows[0][1]), ("c1", rows[0][1].upper() + "!"), ("n", None), ("blank", " "), ("short", "w1 w2"), ("x", "w1 " * 5000)]
    found = neardup.near_duplicates(docs(spark, rows + rows[:5] + [(None, rows[0][1])]), "doc_id", "text", 0.5, 3, 12)
    sets = {i: shingles(t, 3) for i, t in rows if len(re.findall("[a-z0-9]+", (t or "").lower())) >= 12}
    want = {tuple(sorted(p)) for p in combinations(sets, 2) if len(sets[p[0]] & sets[p[1]]) * 2 >= len(sets[p[0]] | sets[p[1]])}
    got = {(r.a, r.b) for r in neardup.duplicate_pairs(found).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    groups = {r.id: r.group for r in neardup.duplicate_groups(found).collect()}
    assert groups["c0"] == groups["c1"] == groups["a0"] == "a0" and "short" not in groups


def test_near_duplicates_that_repeat_a_passage(spark):
    rng = random.Random(14)
    rows = []
    for i in range(40):
        passage, base = [rng.choice(WORDS) for _ in range(30)], [rng.choice(WORDS) for _ in range(50)]
        rows.append((f"a{i}", " ".join(passage * 20 + base)))
        rows.append((f"b{i}", " ".join(passage * rng.randint(15, 25) + edited(rng, base, 2))))
    rows += [("once", rows[0][1]), ("more", " ".join(rows[0][1].split()[:30]) + " " + rows[0][1])]
    found = neardup.near_duplicates(docs(spark, rows), "doc_id", "text", 0.5, 3, 12)
    sets = {i: shingles(t, 3) for i, t in rows}
    want = {tuple(sorted(p)) for p in combinations(sets, 2) if len(sets[p[0]] & sets[p[1]]) * 2 >= len(sets[p[0]] | sets[p[1]])}
    assert {(r.a, r.b) for r in neardup.duplicate_pairs(found).collect()} == want and len(want) >= 40
    classes = {r.id: r["class"] for r in found.members.collect()}
    assert classes["a0"] == classes["once"] == classes["more"] == "a0"  # equal sets, other numbers of repeats


@pytest.mark.parametrize(("own", "kept", "template"), [(36, 17, 30), (27, 8, 40)])
def test_near_duplicates_among_boilerplate(spark, own, kept, template):
    """Pairs at similarity 0.54, of whose shingles 44 or 58 % stand in every text."""
    rng = random.Random(24)
    some = lambda n: [f"{rng.choice(WORDS)}x{rng.randrange(1000)}" for _ in range(n)]
    common, rows = some(template), []
    for i in range(120):
        base = some(own)
        rows += [(f"a{i}", " ".join(common + base)), (f"b{i}", " ".join(common + base[:kept] + some(own - kept)))]
    found = neardup.near_duplicates(docs(spark, rows), "doc_id", "text", 0.5, 3, 12)
    got = {(r.a, r.b) for r in neardup.duplicate_pairs(found).collect()}
    assert got <= {(f"a{i}", f"b{i}") for i in range(120)} and len(got) >= 114


def test_darts_fill_every_coordinate():
    rng = np.random.default_rng(3)
    doc, item = np.repeat(np.arange(64), 5), rng.integers(0, 1 << 62, 320).astype(np.uint64)
    full = neardup.throw(doc, item, np.zeros(320, bool), 65, 208)
    assert full[:64].all() and not full[64].any()
    alone = np.concatenate([neardup.throw(np.zeros(5, np.int64), item[i : i + 5], np.zeros(5, bool), 1, 208) for i in range(0, 320, 5)])
    assert (alone == full[:64]).all()


def test_dart_agreement_is_the_likeness():
    rng = np.random.default_rng(4)
    both, own = rng.integers(0, 1 << 62, (200, 40)).astype(np.uint64), rng.integers(0, 1 << 62, (2, 200, 20)).astype(np.uint64)
    doc = np.repeat(np.arange(200), 60)
    a, b = (neardup.throw(doc, np.concatenate([both, o], 1).ravel(), np.zeros(12000, bool), 200, 208) for o in own)
    assert abs((a == b).mean() - 0.5) < 0.01


def test_near_duplicates_of_long_texts(spark):
    """Texts of 6,000 words, pairs of which share two thirds of their shingles."""
    rng = random.Random(33)
    rows = []
    for i in range(30):
        base = [f"w{rng.randrange(40000)}" for _ in range(6000)]
        cut = rng.randrange(1000)
        rows += [(f"a{i}", " ".join(base)), (f"b{i}", " ".join(base[: cut + 200] + [f"w{rng.randrange(40000)}" for _ in range(1200)] + base[cut + 1400 :]))]
    found = neardup.near_duplicates(docs(spark, rows), "doc_id", "text", 0.5, 3, 12)
    assert {(r.a, r.b) for r in found.links.collect()} == {(f"a{i}", f"b{i}") for i in range(30)}
    assert all(0.6 < r.similarity < 0.7 for r in found.links.collect())


def test_pairs_of_a_large_class_come_from_many_parts(spark):
    names = [f"d{i:02d}" for i in range(37)]
    found = neardup.NearDuplicates(spark.createDataFrame([(n, "d00") for n in names] + [(f"e{i}", "e0") for i in range(9)], "id string, class string"), spark.createDataFrame([("d00", "e0", 0.7)], "a string, b string, similarity double"))
    pairs = [(r.a, r.b) for r in neardup.duplicate_pairs(found, block=5).collect()]
    want = set(combinations(sorted([*names, *(f"e{i}" for i in range(9))]), 2))
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_no_near_duplicate_at_the_threshold_is_left_out(spark):
    """Pairs of which just half of the shingles, or one less or more, are in both; half of them amid boilerplate."""
    rng = random.Random(52)
    some = lambda n: [f"{rng.choice(WORDS)}x{rng.randrange(1000)}" for _ in range(n)]
    common, rows = some(30), []
    for i in range(200):
        head, own = (common, 30) if i % 2 else ([], 60)
        for size in (rng.randint(35, 95), 60):
            base = some(own)
            kept = min(own, -(-(own + size + 2 * len(head)) // 3) - len(head) + rng.randint(0, 2))
            rows += [(f"a{i}-{size}", " ".join(head + base)), (f"b{i}-{size}", " ".join(head + base[:kept] + some(max(size - kept, 0))))]
    found = neardup.near_duplicates(docs(spark, rows), "doc_id", "text", 0.5, 3, 12)
    sets = {i: shingles(t, 3) for i, t in rows}
    want = {tuple(sorted(p)) for p in combinations(sets, 2) if len(sets[p[0]] & sets[p[1]]) * 2 >= len(sets[p[0]] | sets[p[1]])}
    assert {(r.a, r.b) for r in neardup.duplicate_pairs(found).collect()} == want and len(want) >= 200


def test_an_id_of_two_texts_is_compared_by_the_one_that_counts(spark):
    rng = random.Random(53)
    rows = []
    for i in range(20):
        for kind in "xy":
            base = [f"w{rng.randrange(40000)}" for _ in range(60)]
            rows += [(f"d{i}", " ".join(base)), (f"{kind}{i}", " ".join(edited(rng, base, 1)))]
    found = neardup.near_duplicates(docs(spark, rows), "doc_id", "text", 0.5, 3, 12)
    assert sorted(r.a for r in neardup.duplicate_pairs(found).collect()) == sorted(f"d{i}" for i in range(20))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 40), st.integers(0, 200)), min_size=1, max_size=12), st.sampled_from([0.3, 0.5, 0.8, 1.0]), st.integers(1, 5), st.integers(0, 1000))
def test_the_sieve_keeps_every_pair_that_is_alike(parts, least, words, seed):
    """Sets of three kinds of items: from few items that many have, from a family's and their own."""
    rng = np.random.default_rng(seed)
    sets = [np.unique(np.concatenate([rng.permutation(60)[:a], 100 + rng.permutation(40)[:b], 1000 * (i + 1) + np.arange(c)])) for i, (a, b, c) in enumerate(parts)]
    sets = [s for s in sets if len(s)]
    if not sets:
        return
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = neardup.mix(np.concatenate(sets).astype(np.uint64) + np.uint64(1))
    sketch = neardup._sketches(doc, h, len(sets), words)
    part, text, entry = neardup.index_entries(doc, h, (h >> np.uint64(54)).astype(np.uint16) // 100, least, 3)
    got = set()
    for p in range(3):
        mine = np.flatnonzero(part == p)
        tops = text[mine[entry[mine] & 1 == 1]]
        head = np.concatenate([tops[:, None].astype(np.uint32), np.bincount(doc)[tops][:, None].astype(np.uint32), sketch[tops]], 1)
        got |= set(map(tuple, neardup.sieve(head, entry[mine], least).tolist()))
    alike = {(i, j) for i, j in combinations(range(len(sets)), 2) if len(np.intersect1d(sets[i], sets[j])) >= least * len(np.union1d(sets[i], sets[j])) - 1e-9}
    equal = {(i, j) for i, j in alike if np.array_equal(sets[i], sets[j])}
    assert alike - equal <= got


def test_near_duplicates_of_nothing(spark):
    found = neardup.near_duplicates(docs(spark, []), "doc_id", "text")
    assert neardup.duplicate_pairs(found).count() == 0 == neardup.duplicate_groups(found).count()


def test_copies_only(spark):
    t = " ".join(WORDS[:40])
    found = neardup.near_duplicates(docs(spark, [(f"d{i}", t) for i in range(6)]), "doc_id", "text")
    assert found.links.count() == 0 and neardup.duplicate_pairs(found).count() == 15


# leakage
def test_leakage(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(40))) for i in range(20)] + [(98, "too short"), (99, None), (5, None)]
    rows = []
    for i in range(80):
        t = [rng.choice(WORDS) for _ in range(rng.randint(0, 50))]
        if i % 2:
            src, k = items[rng.randrange(20)][1].split(), rng.randint(8, 14)
            s = rng.randrange(40 - k)
            t += src[s : s + k]
        rows.append((f"d{i}", " ".join(t)))
    rows += [("n", None), ("whole", items[0][1].upper().replace(" ", ", ")), ("long", "x " * 100_000 + items[1][1])]
    ask = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    runs = lambda t: {tuple(w[i : i + 10]) for w in [re.findall("[a-z0-9]+", (t or "").lower())] for i in range(len(w) - 9)}
    want = {(d, i) for d, t in rows for i, x in items if runs(t) & runs(x)}
    for block in (20_000, 4):
        got = leakage.leaked_items(docs(spark, rows + rows[:9]), "doc_id", "text", ask, "item_id", "text", items_per_block=block)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want and got.count() == len(want)
    assert leakage.leaked_items(docs(spark, []), "doc_id", "text", ask, "item_id", "text").count() == 0
    assert leakage.leaked_items(docs(spark, rows), "doc_id", "text", ask.limit(0), "item_id", "text").count() == 0


# packing
@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_bins_hold_everything(lengths):
    bins = packing.minimum_slack(lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 50 for b in bins)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(0, 30))
def test_fullest_is_fullest(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    used = packing.fullest(counts, room)
    assert all(k <= counts[n] for n, k in used)
    assert sum(n * k for n, k in used) == max(s for s in sums if s <= room)


def test_sequences(spark):
    rows = [("a", "claim " * 700), ("a", "claim " * 700), ("a", "claim " * 3), ("b", "short note"), ("n", None), ("e", ""), (None, "x"), ("s", " ")]
    got = packing.pack_sequences(docs(spark, rows), "doc_id", "text", capacity=100).collect()
    sizes = Counter()
    for r in got:
        sizes[r.sequence] += r.tokens
    assert max(sizes.values()) <= 100
    enc = packing.load_tokenizer(Path(packing.TOKENIZER).read_bytes())
    want = Counter()
    for i, t in rows:
        if i and t:
            want[i] += len(enc.encode_ordinary(t))
    have = Counter()
    for r in got:
        have[r.doc_id] += r.tokens
    assert have == want and "e" not in have
    assert packing.pack_sequences(docs(spark, []), "doc_id", "text").count() == 0


# encodings
def test_mojibake(spark):
    clean = ["Das Café in München öffnet für größere Gäste", "L’assuré a déclaré le bagage égaré près de l’hôtel", "Владелец сообщил про пожар дома после грозы", "właściciel zgłosił kradzież bagażu w Łodzi", "Naïve façade – £20 or €30 “quoted”"]
    rows = [(f"c{i}", t) for i, t in enumerate(clean * 12)]
    hurt = {
        "utf8": clean[0].encode().decode("cp1252"), "twice": clean[0].encode().decode("cp1252").encode().decode("cp1252"),
        "dos": clean[0].encode().decode("cp437"), "mac": clean[1].encode().decode("mac_roman"), "koi": clean[2].encode("koi8-r").decode("cp1251"), "cyr": clean[2].encode("cp1251").decode("cp1252"), "pl": clean[3].encode("cp1250").decode("cp1252", "replace"), "lost": clean[0].encode("latin-1").decode("utf-8", "replace"),
    }
    rows += list(hurt.items()) + [("n", None), ("empty", ""), ("box", "│ ─ ┐ ok"), ("ascii", "plain text?"), (None, hurt["utf8"])]
    df = docs(spark, rows)
    assert {r.doc_id for r in mojibake.damaged_documents(df, "doc_id", "text").collect()} == set(hurt)
    put = {r.doc_id: r.restored for r in mojibake.restore_documents(df, "doc_id", "text").collect()}
    for k in ("utf8", "twice", "dos"):
        assert put[k] == clean[0]
    assert put["mac"] == clean[1] and "Владелец сообщил" in put["koi"] and "Владелец сообщил" in put["cyr"] and "kradzież" in put["pl"] and "München" in put["lost"]
    assert mojibake.damaged_documents(docs(spark, []), "doc_id", "text").count() == 0


@pytest.mark.parametrize("wrong", ["cp1252", "cp1251", "cp437", "mac_roman"])
def test_mojibake_of_the_main_user_of_a_language(spark, wrong):
    polish, russian, quoted = "Właściciel zgłosił kradzież bagażu, ósma półka", "Владелец сообщил про пожар дома", "The insured’s “old” car – £20"
    misread = lambda t: "".join(bytes([b]).decode(wrong) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D, 0x98) else bytes([b]).decode(wrong, "ignore") or chr(b) for b in t.encode())
    rows = [(f"bad{k}{i}", misread(t)) for k, t in enumerate([polish, russian, quoted]) for i in range(20)]
    rows += [("ok0", polish), ("ok1", russian), ("ok2", quoted), ("ok3", "CAFÉ™ “É” №5 l’été… «Ёлка» 5 m² │ ─┐ Nestlé®")]
    put = {r.doc_id: r.restored for r in mojibake.restore_documents(docs(spark, rows), "doc_id", "text").collect()}
    assert set(put) == {i for i, _ in rows if i.startswith("bad")}
    for k, t in enumerate([polish, russian, quoted]):
        assert put[f"bad{k}0"] == t


def test_mojibake_with_lost_bytes(spark):
    word = "größenänderung"
    hurt = {"mixed": "gr\ufffdßenänderung", "double": "größen\ufffd\ufffdnderung"}
    rows = [(f"c{i}", f"eine {word} hier") for i in range(5)] + [(f"o{i}", "eine grüßenänderung hier") for i in range(9)] + [(k, f"eine {w} hier") for k, w in hurt.items()]
    put = {r.doc_id: r.restored for r in mojibake.restore_documents(docs(spark, rows), "doc_id", "text").collect()}
    assert put == {"mixed": "eine grüßenänderung hier", "double": f"eine {word} hier"}


def test_mojibake_of_unseen_characters(spark):
    rows = [(x, f"{c}first w{c}ord".encode().decode("cp1252")) for x, c in [("bom", "\ufeff"), ("narrow", "\u202f"), ("zero", "\u200b")]] + [("soft", "pre\xadfix".encode().decode("latin-1")), ("no", "first word")]
    assert {r.doc_id for r in mojibake.damaged_documents(docs(spark, rows), "doc_id", "text").collect()} == {"bom", "narrow", "zero", "soft"}


# personal details
def test_personal_details(spark):
    lexicon = spark.createDataFrame([("Rhea", "given"), ("Emre", "given"), ("Navlow", "family"), ("Tamrigg", "family"), (None, "given")], "name string, kind string")
    rows = [(f"f{i}", f"Spoke with {a} {b} at 9:{i:02d} am. Repairs by Northstar Building Group run late.") for i, (a, b) in enumerate([("Rhea", "Navlow"), ("Emre", "Tamrigg"), ("Rhea", "Tamrigg")] * 10)]
    rows += [
        ("m", "Mrs Rhea O’Navlow-Brown emailed from Rhea.N@Example.org; call (08) 5550 7111 or +61 491 570 159."),
        ("o", "Write to jo (at) inbox dot test. Medicare no. 2346 01964 8, DL# w139469, passport K7118161."),
        ("a", "Witness lives at Unit 7/130 Ruthlow Terrace Yarradong 0826, seen on Baxlow Avenue."),
        ("x", "Invoice 523 447 740, file no. 0440-8933, CLM-05729174, policy DL7704410, 13 June 2023, Tillaton North."),
        ("low", "Payee is Ms emre tamrigg for $20."), ("cap", "SPOKE WITH MS RHEA NAVLOW AT 9 AM."), ("n", None), ("e", ""),
    ]
    df = docs(spark, rows + rows[-3:] + [(None, "Mr Emre Navlow")])
    got = {}
    for r in pii.personal_details(df, "doc_id", "text", lexicon).collect():
        got.setdefault(r.doc_id, set()).add((r.kind, r.found))
    assert got["f0"] == {("name", "Rhea Navlow")}
    assert got["m"] == {("name", "Rhea O’Navlow-Brown"), ("email", "rhea.n@example.org"), ("phone", "0855507111"), ("phone", "61491570159")}
    assert got["o"] == {("email", "jo (at) inbox dot test"), ("identity", "2346019648"), ("identity", "W139469"), ("identity", "K7118161")}
    assert got["a"] == {("address", "Unit 7/130 Ruthlow Terrace")} and "x" not in got
    assert got["low"] == {("name", "emre tamrigg")} and got["cap"] == {("name", "RHEA NAVLOW")}
    put = {r.doc_id: r.sanitised for r in pii.sanitise(df, "doc_id", "text", lexicon).collect()}
    assert put["a"] == "Witness lives at <ADDRESS> Yarradong 0826, seen on Baxlow Avenue." and put["n"] is None and put["x"] == dict(rows)["x"]
    assert pii.personal_details(docs(spark, []), "doc_id", "text", lexicon).count() == 0


def test_lost_bytes_are_wildcards_in_the_lattice():
    words = [("münchen", 5), ("mänchen", 2), ("mőnchen", 99), ("munchen", 500)]
    lost = mojibake.LOST
    assert mojibake.fill_lost(f"M{lost}nchen,", words) == "Mőnchen,"  # one mark for a character: the commonest word
    assert mojibake.fill_lost(f"MÃ{lost}nchen,", words) == "München,"  # the first byte is left and rules the others out
    assert mojibake.fill_lost(f"M{lost}¼nchen", words) == "München"  # the second byte is left
    assert mojibake.fill_lost(f"M{lost}{lost}NCHEN!", words[:2]) == "MÜNCHEN!"  # a mark a byte
    assert mojibake.fill_lost(f"r{lost}serv{lost}e", [("réservée", 3), ("réservee", 9)]) == "réservée"
    assert mojibake.fill_lost(f"dÃ©clar{lost}", [("déclaré", 3), ("déclara", 9)]) == "déclaré"  # misread and lost in one word
    assert mojibake.fill_lost(f"h{lost}", [("há", 90), ("hà", 2)]) == "há" and mojibake.fill_lost(f"h{lost}", [("há", 9), ("hà", 2)]) is None
    assert mojibake.fill_lost(f"{lost}34", words) is None and mojibake.fill_lost(f"x{lost}y", []) is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("abZ 09é-\x00\n", max_size=60)), max_size=12))
def test_words_are_hashed_as_they_are_read(texts):
    lengths, hashes = hashed_words(texts)
    words = [w for t in texts for w in words_of(t)]
    assert lengths.tolist() == [len(words_of(t)) for t in texts] and len(hashes) == len(words)
    assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))


def test_equal_words_hash_alike_anywhere():
    texts = ["x " * n + "claim" for n in range(50)] + ["claim " * 60_000, "CLAIM"]
    lengths, hashes = hashed_words(texts)
    ends = lengths.cumsum() - 1
    assert len(set(hashes[ends].tolist())) == 1 and lengths[-2] == 60_000


def test_packing_leaves_little_room_over_many_shards(spark, monkeypatch):
    """60,000 texts in three shards: at least 99 % of the sequences' room is used, alike on every partitioning."""
    rng = random.Random(12)
    sizes = [min(int(rng.lognormvariate(5.5, 1.1)) + 1, 9000) for _ in range(60_000)]
    held = spark.createDataFrame([(f"d{i}", n, i) for i, n in enumerate(sizes)], "id string, tokens bigint, hash bigint")
    monkeypatch.setattr(packing, "token_counts", lambda df, *_: df)
    packed = [packing.pack_sequences(df, "id", "text") for df in (held, held.repartition(11))]
    used = packed[0].groupBy("sequence").sum("tokens").toPandas()["sum(tokens)"]
    assert used.max() <= 2048 and used.sum() == sum(sizes) and used.sum() / (2048 * len(used)) > 0.99
    assert packed[0].exceptAll(packed[1]).count() == 0


def test_repeated_rows_are_packed_each(spark):
    rows = [("a", "claim " * 30)] * 2500 + [("b", "water " * 9)] * 3
    got = packing.pack_sequences(docs(spark, rows), "doc_id", "text", capacity=64, shard_items=500).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {"a": 2500, "b": 3}


def test_words_before_numbers_tell_telephones_from_others(spark):
    """The same form of number is one or isn't by what the corpus puts beside it."""
    lexicon = spark.createDataFrame([("Rhea", "given")], "name string, kind string")
    rows = [(f"d{i:02d}", f"Docket 555 {100 + i} 4567 was closed.") for i in range(40)] + [(f"s{i:02d}", f"Please call 0412 345 {100 + i} today.") for i in range(40)] + [(f"w{i:02d}", f"Please call 555 {100 + i} 9876 today.") for i in range(40)]
    got = {r.doc_id[0]: r.kind for r in pii.personal_details(docs(spark, rows), "doc_id", "text", lexicon).collect()}
    assert got == {"s": "phone", "w": "phone"}
    alone = pii.personal_details(docs(spark, rows[-1:]), "doc_id", "text", lexicon).collect()
    assert [(r.kind, r.found) for r in alone] == [("phone", "5551399876")]  # without evidence the form decides


@pytest.mark.parametrize("broadcast_rows", [1000, 1])
def test_one_row_an_id(spark, broadcast_rows):
    rows = [("a", "x", 1), ("a", "x", 1), ("a", "b", 9), ("b", None, 2), ("c", "y", None), ("c", None, 5), (None, "z", 3), (None, "z", 3)] + [("hot", f"t{i}", i) for i in range(50)]
    got = one_per_id(spark.createDataFrame(rows, "doc_id string, text string, _n int"), "doc_id", "text", broadcast_rows=broadcast_rows).collect()
    assert {r.doc_id: r.text for r in got} == {"a": "b", "b": None, "c": None, "hot": "t0"} and len(got) == 4
    assert one_per_id(spark.createDataFrame([], "doc_id string, text string"), "doc_id", "text").count() == 0


def test_lost_bytes_in_words_without_ascii_letters(spark):
    """Words of other scripts, alone or read under a swapped encoding as well, and tokens of which only a part can be put right."""
    lost = mojibake.LOST
    sound = [(f"s{i}", "Владелец сообщил о протечке на кухне, źródłem zniszczeń był wąż") for i in range(5)]
    hurt = {
        "one": f"Вла{lost}елец сообщил", "two": f"владел{lost}{lost}ц", "end": f"сообщи{lost}!", "first": f"{lost}ротечке", "caps": f"КУХ{lost}Е",
        "swap": "Владелец".encode("cp1251").decode("cp1252").replace("ä", lost), "part": f"dÃ©z{lost}zq", "none": f"{lost}{lost}",
    }
    got = {r.doc_id: r.restored for r in mojibake.restore_documents(docs(spark, sound + list(hurt.items()) + [("é", "é é é é")]), "doc_id", "text").collect()}
    want = {"one": "Владелец сообщил", "two": "владелец", "end": "сообщил!", "first": "протечке", "caps": "КУХНЕ", "swap": "Владелец", "part": f"déz{lost}zq", "none": f"{lost}{lost}"}
    assert got == want
    assert mojibake.lost_keys(f"{lost}{lost}") == [] and ("ела", 6) not in mojibake.word_keys("елец") and ("еле", 4) in mojibake.word_keys("елец")
