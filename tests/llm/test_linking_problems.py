"""Name variants, near-duplicates, packing, mixing, shared spans: brute force and edge cases."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from corpusloom.llm import mixing as M
from corpusloom.llm import name_variants as N
from corpusloom.llm import near_duplicates as ND
from corpusloom.llm import packing as P
from corpusloom.llm import shared_spans as SP
from corpusloom.llm import tokens as T


def test_names(spark):
    reg = spark.createDataFrame([(1, "person", "Kroulowask, Yolanda", "Kroulowask", "Yolanda"), (2, "person", "Möskatou, Michael Elias", "Möskatou", "Michael Elias"), (3, "org", "National Taiwevil Laboratory for Dialect Mapping", None, None), (4, "person", "Feploudour, Adrian", "Feploudour", "Adrian"), (5, "person", "Feploudour, Amelia", "Feploudour", "Amelia"), (6, "person", "Plékegler-Dröun, Samuel", "Plékegler-Dröun", "Samuel"), (7, "org", "University of Weskegli Centre for Glacier Physics", None, None)], "entity_id long, kind string, name string, family string, given string")
    cases = {
        "Yolanda Kroulowask": 1, "KROULOWASK, Yolanda": 1, "Kroulowask Y": 1, "Y. Kroulowask": 1, "kroulowaask, y": 1, "Kroulowask, Yoli": 1, "Yolanda, Kroulowask": 1, "Kroulowask, Yolanda, PhD": 1, "Dr. Yolanda Kroulowask*": 1, "Kroulowask, Yolnada": 1,
        "Moskatou, M. E.": 2, "Möskatou ME": 2, "Mike Möskatou": 2, "Michael Elias Moeskatou": 2, "Natl. Taiwevil Lab. for Dialect Mapping": 3, "NTLDM": 3, "The National Taiwevil Laboratory f. Dialect Mapping": 3, "National Taiwvil Laboratory for Dialect Mapping": 3,
        "Feploudour, Amelia.": 5, "Feploudour, A.": None, "Kroulowask, Walter": None, "Kroulowask, W.": None, "Somebody Else": None, "Dröun Plékegler, S.": 6, "Weskegli Centre for Glacier Physics University": 7, "": None, None: None, "Kroulowask, Yolanda": None,
    }
    docs = spark.createDataFrame([(k, [s], "c") for k, s in enumerate(cases)] + [(100, [], "c"), (101, None, "c"), (102, ["x", "Kroulowask Y"], "c"), (102, ["x", "Kroulowask Y"], "c")], "doc_id long, authors array<string>, spelling string")
    got = {(r.doc_id, r.author_pos): r.entity_id for r in N.attribute_entries(docs, reg).collect()}
    want = {(k, 1): e for k, (s, e) in enumerate(cases.items()) if e}
    assert got == want | {(102, 2): 1}
    assert N.attribute_entries(docs.limit(0), reg).count() == 0 and N.attribute_entries(docs, reg.limit(0)).count() == 0


def test_every_explained_pair_of_names_meets(spark):
    words = ["Alpine", "Botany", "Climate", "Desert", "Estuary", "Forest", "Glacier", "Heath"]
    # all words are shared by many organisations, none has one of its own
    orgs = [f"{' '.join(c)} Institute" for c in combinations(words, 4)] + ["University Department Faculty Group", "Marine Data Natural Centre"]
    people = [("Li", "Wei"), ("Weskeglitrandoum", "Ida"), ("van den Hoogkerk", "Jan"), ("Koul", "Vera"), ("Plékegler-Dröun", "Samuel")]
    canon = [("org", n, None, None, f"E{k}") for k, n in enumerate(orgs)] + [("person", f"{f}, {g}", f, g, f"E{100 + k}") for k, (f, g) in enumerate(people)]
    typed = [f"Institute {' '.join(n.split()[3::-1])}" for n in orgs[:70]] + [
        "Inst. Desert Botany Climte Alpine", "Alp. Bot. Clim. Des. Inst", "Department University Faculty Group", "MD", "MDNC", "Li, W.", "W. Li", "Wei Li", "Wesekglitrandom, Ida", "Ida Weskeglitrandoumx", "Vandenhoogkerk, J.",
        "Koal, Vera", "Vera Koull", "Drounplekegler, S.", "Plekegler Dröun, Samuel, PhD", "Somebody, Else", "—", "Jan van den Hogkerk", "Hoogkerk, Jan",
    ]
    df = spark.createDataFrame([(s,) for s in typed], "spelling string")
    got = N.likelihoods(N.typed_words(df), spark.createDataFrame(canon, "kind string, name string, family string, given string, cid string"))
    cost = {(s, c[4]): N.org_cost(s, c[1]) if c[0] == "org" else N.person_cost(s, c[2], c[3]) for s in typed for c in canon}
    want = {p: x for p, x in cost.items() if x is not None}
    assert {(s, e) for s, e in want} >= {(s, f"E{k}") for k, s in enumerate(typed[:70])} and len({s for s, _ in want}) >= 82
    assert {(r.spelling, r.cid): r.cost for r in got.collect()} == want
    reg = spark.createDataFrame([(k, "org", n, None, None) for k, n in enumerate(orgs)], "entity_id long, kind string, name string, family string, given string")
    docs = spark.createDataFrame([(k, [s]) for k, s in enumerate(typed[:70])], "doc_id long, authors array<string>")
    assert {(r.doc_id, r.entity_id) for r in N.attribute_entries(docs, reg).collect()} == {(k, k) for k in range(70)}


def test_distance():
    assert [N.distance(*x, 2) for x in (("abc", "abc"), ("abc", "acb"), ("abc", "abdc"), ("abcd", "dcba"), ("a", "abcd"))] == [0, 1, 1, 3, 3]


def texts(seed, n=120):
    rng = random.Random(seed)
    voc = [f"w{k}" for k in range(600)]
    base = [" ".join(rng.choice(voc) for _ in range(rng.randint(30, 90))) for _ in range(n)]
    out = []
    for k, t in enumerate(base):
        out.append(t)
        for _ in range(rng.choice([0, 0, 1, 3])):
            words = t.split()
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(voc)
            out.append(" ".join(words))
    out += [base[0]] * 40  # a group of copies
    return list(enumerate(out))


def brute(rows, size, similarity, least):
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in re.findall("[A-Za-z0-9]+", t or "")]
        s = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
        if len(s) >= least:
            sets[i] = s
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def test_crowded_blocks_lose_no_pair(spark, monkeypatch):
    rows = texts(11, 60)
    template = " ".join(f"t{k}" for k in range(80)).split()
    rng = random.Random(12)
    for n in range(90):  # edited copies of one template: a hot group
        words = list(template)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(80)] = f"e{rng.randrange(400)}"
        rows.append((1_000 + n, " ".join(words)))
    df = spark.createDataFrame(rows, "id long, text string")
    want = brute(rows, 3, 0.7, 20)
    whole = {tuple(r) for r in ND.similar_pairs(df, "id", "text", size=3, similarity=0.7, min_shingles=20).collect()}
    monkeypatch.setattr(ND, "OFTEN", 4)  # crowds are told before the shuffle
    split = {tuple(r) for r in ND.similar_pairs(df, "id", "text", size=3, similarity=0.7, min_shingles=20, hot=10).collect()}
    assert split <= want and whole <= want and whole <= split and len(want - split) <= 0.002 * len(want)


@pytest.mark.parametrize("hot", [300, 3])
def test_near_duplicates(spark, hot):
    rows = texts(1)
    edge = [(900, None), (901, ""), (902, "too short"), (903, "long " + " ".join(f"v{k}" for k in range(50_000)))]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows + edge], "chunk_id long, text string, _id string, a int")
    got = {tuple(r) for r in ND.similar_pairs(df, "chunk_id", "text", size=3, similarity=0.7, min_shingles=20, hot=hot).collect()}
    want = brute(rows + edge, 3, 0.7, 20)
    assert got <= want and len(want - got) <= 0.005 * len(want)
    assert ND.similar_pairs(df.limit(0), "chunk_id", "text").count() == 0
    assert ND.similar_pairs(df.where("chunk_id < 3").unionByName(df.where("chunk_id < 3")), "chunk_id", "text", min_shingles=20).where("id_a = id_b").count() == 0


def test_pair_that_shares_only_a_crowded_block(spark):
    rng = random.Random(3)
    while True:
        x = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        y = x[:83] + [f"w{rng.randrange(10**6)}" for _ in range(17)]
        owner, h = ND.shingles([" ".join(x), " ".join(y)], 3, {})
        keys = ND.block_keys(ND.fingerprints(h, np.array([0, 98])))
        if (keys[0] == keys[1]).sum() == 1:
            break
    block = set(keys[0][keys[0] == keys[1]].tolist())
    rows = [(1, " ".join(x)), (2, " ".join(y))]
    for k in range(2, 100):  # near-copies of x that have the pair's block too
        z = " ".join(x[:k] + ["changed"] + x[k + 1 :])
        _, h = ND.shingles([z], 3, {})
        if len(rows) < 5 and block & set(ND.block_keys(ND.fingerprints(h, np.array([0])))[0].tolist()):
            rows.append((k + 10, z))
    df = spark.createDataFrame(rows, "chunk_id long, text string")
    got = {tuple(r) for r in ND.similar_pairs(df, "chunk_id", "text", size=3, similarity=0.7, min_shingles=20, hot=3).collect()}
    assert (1, 2) in got and got == brute(rows, 3, 0.7, 20)


@pytest.mark.parametrize("hot", [300, 3])
def test_rare_shingles_leave_no_pair_out(spark, hot):
    rows = texts(2)
    df = spark.createDataFrame(rows, "_id long, _text string")
    got = {tuple(r) for r in ND.pairs_by_rare_shingles(df, 3, 0.7, hot).collect()}
    assert brute(rows, 3, 0.7, 1) <= got


def test_last_member_of_a_crowded_block(spark):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        rows = [(1, k) for k in range(6)] + [(b, 100 + b) for b in range(2, 60)]
        got = ND.pairs_in_blocks(spark.createDataFrame(rows, "block long, _id long"), 4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert sorted(r.a for r in got) == list(range(6)) and all(r.b is None for r in got)


def levenshtein(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_doi_pairs(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        s = "10.5000/" + "".join(rng.choice("abc1") for _ in range(rng.randint(1, 14)))
        rows.append(s)
        for _ in range(2):
            t = list(s)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(3, len(t))
                t[at : at + rng.choice([0, 1])] = rng.choice(["", "x", "b"])
            rows.append("".join(t))
    raw = [f"doi: {x.upper()} ;" if k % 3 == 0 else f"https://doi.org/{x}" if k % 3 == 1 else x for k, x in enumerate(rows)] + ["", " ", None, "10.", "no doi"]
    df = spark.createDataFrame(list(enumerate(raw)), "doc_id long, doi string")

    def plain(x):
        k = (x or "").find("10.")
        return re.sub(r"[\]).,;]+$", "", x[k:].lower().replace(" ", "")) if k >= 0 else None

    codes = {i: c for i, x in enumerate(raw) if (c := plain(x))}
    want = {(a, b) for a in codes for b in codes if a < b and abs(len(codes[a]) - len(codes[b])) <= 2 and levenshtein(codes[a], codes[b]) <= 2}
    assert {tuple(r) for r in ND.doi_pairs(df).collect()} == want


def test_packing(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 5, 40, 64, 65, 128, 200, 999, 0])) for i in range(500)] + [(1000, None), (7, 30)]
    df = spark.createDataFrame([(i, n, "x") for i, n in rows], "doc_id long, n_tokens long, plan string")
    for items in (10_000, 60):
        got = P.pack_records(df, [("a", 64), ("b", 1000), ("none", 0)], group_items=items).collect()
        for plan, c in (("a", 64), ("b", 1000)):
            mine = [r for r in got if r.plan == plan]
            boxes = defaultdict(int)
            for r in mine:
                boxes[r.container] += r["size"]
            assert max(boxes.values()) <= c
            assert sum(boxes.values()) == sum(n or 0 for _, n in rows)
            parts = defaultdict(list)
            for r in mine:
                parts[r.doc_id].append((r.start, r["size"]))
            assert all(len(parts[i]) == -(-n // c) for i, n in rows if n and i != 7)
    assert {r.plan for r in got} == {"a", "b"}
    assert P.pack_records(df.limit(0), [("a", 64)]).count() == 0
    sizes = [rng.randint(1, 300) for _ in range(3000)]
    boxes = P.pack(sizes, 1000)
    assert sum(sizes) / (len(boxes) * 1000) > 0.99 and sorted(i for b in boxes for i in b) == list(range(3000))


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world", "k"), (2, "", "k"), (3, None, None), (4, "<|endoftext|>", "k")], "doc_id long, text string, source string")
    got = {r.doc_id: r.n_tokens for r in T.token_counts(df, "doc_id", "text", also=("source",)).collect()}
    assert (got[1], got[2], got[3]) == (2, 0, 0) and got[4] > 1


def test_schedule():
    rng = random.Random(6)
    for _ in range(20):
        blocks = {f"s{k}": rng.randint(1, 60) for k in range(rng.randint(1, 8))}
        order = M.schedule(blocks)
        total = sum(blocks.values())
        done = Counter()
        for slot, (s, j) in enumerate(order, 1):
            assert done[s] == j
            done[s] += 1
            assert all(abs(done[k] - slot * n / total) < 1 + 1e-9 for k, n in blocks.items())
        assert done == Counter(blocks)


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, "big" if i < 700 else "small" if i < 760 else "other" if i < 800 else None, rng.randint(20, 200)) for i in range(820)] + [(900, "big", 0), (901, "small", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, n_tokens long, slot string")
    targets = [("big", 0.7, 1), ("small", 0.3, 3), ("missing", 0.0, None)]
    got = M.mix(df, targets, block_tokens=500).collect()
    used = Counter((r.source, r.doc_id) for r in got)
    assert max(n for (s, _), n in used.items() if s == "big") == 1 and max(n for (s, _), n in used.items() if s == "small") <= 3
    share = {r.source: r for r in M.reached_shares(M.mix(df, targets, block_tokens=500), targets).collect()}
    assert share["big"].actual_share == pytest.approx(0.7, abs=0.01) and share["missing"].tokens == 0
    ordered = sorted(got, key=lambda r: (r.slot, r.offset))
    tokens = Counter()
    for r in ordered:
        tokens[r.source] += r.n_tokens
        total = sum(tokens.values())
        assert abs(tokens["small"] - 0.3 * total) < 500 + 2 * 200 + 60
    assert M.mix(df.limit(0), targets).count() == 0 and M.mix(df, []).count() == 0


def test_mixing_gives_all_that_caps_allow(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, "abc"[i % 10 // 4 if i % 10 < 8 else 2], rng.randint(20, 200)) for i in range(2_000)], "doc_id long, source string, n_tokens long")
    have = {r.source: r.n for r in df.groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    targets = [("a", 0.5, 1), ("b", 0.2, None), ("c", 0.3, 1)]
    got = M.mix(df, targets, block_tokens=400, exact_shares=False).collect()
    need = {s: min(p * sum(have.values()), (c or 99) * have[s]) for s, p, c in targets}
    tokens = Counter()
    for r in got:
        tokens[r.source] += r.n_tokens
    assert all(need[s] <= tokens[s] < need[s] + 200 for s in need)
    assert max(Counter((r.source, r.doc_id) for r in got if r.source != "b").values()) == 1
    assert len({(r.source, r.offset) for r in got}) == len(got)


def test_schedule_in_periods(spark):
    for seed in range(6):
        rng = random.Random(seed)
        blocks = {f"s{k}": rng.choice([1, 3, 40, 700, rng.randint(1, 3_000)]) for k in range(8)}
        total = sum(blocks.values())
        for shortest in (16, 64, 100_000):
            p = M.Periods(blocks, shortest=shortest)
            plan = [x for k in range(p.count) for x in p.plan(k)]
            assert [x[0] for x in plan] == list(range(total))
            done = Counter()
            for t, s, j in plan:
                assert done[s] == j  # blocks of a source in their order
                done[s] += 1
                assert all(abs(done[x] - blocks[x] * (t + 1) / total) < 2 for x in blocks)  # quanta, half a block each
            assert done == blocks
    one = {(r.slot, r.source, r.block) for r in M.slots_of(spark, {"a": 60, "b": 30}, shortest=8).collect()}
    assert len(one) == 90 and {s for s, *_ in one} == set(range(90))
    assert M.slots_of(spark, {}).count() == 0


def spans(rows, span):
    at = defaultdict(set)
    for i, t in rows:
        for k in range(len(t or "") - span + 1):
            at[t[k : k + span]].add(i)
    pairs = {(a, b) for s in at.values() if len(s) > 1 for a in s for b in s if a < b}
    cover = {}
    for i, t in rows:
        hit = set()
        for k in range(len(t or "") - span + 1):
            if len(at[t[k : k + span]]) > 1:
                hit |= set(range(k, k + span))
        cover[i] = len(hit)
    return pairs, cover


@pytest.mark.parametrize("bucket", [2000, 1])
def test_shared_spans(spark, bucket, monkeypatch):
    monkeypatch.setattr(SP, "BUCKET", bucket)
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [make(rng.randint(30, 90)) for _ in range(6)]
    rows = [(i, make(rng.randint(0, 80)) + (rng.choice(passages)[rng.randint(0, 20) :] if rng.random() < 0.6 else "") + make(rng.randint(0, 60))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "ab" * 300), (203, passages[0] * 2 + make(5)), (204, rows[0][1] + make(40)), (205, rows[0][1] + make(40))]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, mini string")
    pairs, cover = spans(rows, 40)
    assert {tuple(r) for r in SP.sharing_pairs(df, span=40, anchor=8).collect()} == pairs and pairs
    got = {r.doc_id: r for r in SP.shared_part(df, span=40, anchor=8).collect()}
    assert {i: r.shared_chars for i, r in got.items()} == cover and got[200].n_chars == 0
    assert SP.sharing_pairs(df.limit(0)).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"p{k}_found" for k in (1, 2, 3, 4, 5, 6, 7, 10)} | {"p8_pack", "p9_mix"} <= names and set(e.oracle_sql()) <= names
