from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import xxhash

from tidecast.llm import simhash as S
from tidecast.llm.common import word_blocks


def slow_print(text: str, n: int = 3) -> int:
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = text.encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + n]), 42)
              for i in range(max(len(words) - n + 1, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints, radius=3):
    """Smallest reachable id of each row, by comparing every pair."""
    up = list(range(len(ids)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                up[top(i)] = top(j)
    best = {}
    for i, x in enumerate(ids):
        if x is not None:
            best[top(i)] = min(x, best.get(top(i), x))
    return [best.get(top(i)) for i in range(len(ids))]


def test_word_blocks_cover_a_long_text():
    text = ("ab\t c\x0b\x0cd \n" * 400).encode()
    blocks = list(word_blocks(text, keep=2, size=17))
    assert len(blocks) > 10
    assert [w for i, b in enumerate(blocks) for w in (b if not i else b[2:])] == text.split()
    assert list(word_blocks(b"")) == []


def test_fingerprint_of_blocks_is_that_of_the_whole(monkeypatch):
    r = random.Random(1)
    text = " ".join(r.choice(["a", "bb", "c", "été", "x" * 40]) for _ in range(500))
    whole = S.fingerprint(text.encode())
    assert whole == slow_print(text)
    blocks = S.word_blocks
    monkeypatch.setattr(S, "word_blocks", lambda t, keep: blocks(t, keep, 64))
    assert S.fingerprint(text.encode()) == whole
    for short in ("", "  ", "one", "one two", "one two three", "x" * 300):
        assert S.fingerprint(short.encode()) == slow_print(short)


def test_search_is_that_of_all_pairs_with_small_trees(spark):
    r = random.Random(5)
    prints = [r.getrandbits(64) for _ in range(60)]
    for p in list(prints):
        for _ in range(6):
            flips = sum(1 << b for b in r.sample(range(64), r.randint(1, 5)))
            prints.append(p ^ flips)
    base = r.getrandbits(64)
    prints += [base ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "bits long")
    for tree_rows in (4096, 5):
        roots = {r["node"]: r["root"]
                 for r in S.components(S.near_links(df, tree_rows=tree_rows)).collect()}
        want = slow_components(signed, prints)
        assert [roots.get(s, s) for s in signed] == want


def test_rows_of_every_kind(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, "Alpha beta  gamma", 1), (3, "alpha beta gamma", 2), (9, None, 3), (8, "", 4),
            (7, " \n", 5), (7, " \n", 5), (None, "alpha beta gamma", 6), (2, long, 7),
            (4, long + " more", 8), (None, "only this", 9), (11, "é É", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bits int")
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    prints = [slow_print(t or "") for _, t, _ in rows]
    want = sorted(zip((str(i) for i, _, _ in rows), prints,
                      map(str, slow_components([i for i, _, _ in rows], prints)), strict=True))
    assert sorted((str(r["doc_id"]), r["bits"] % (1 << 64), str(r["component_id"]))
                  for r in got) == want
    kept = S.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 7, 11]


def test_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(none).collect() == []
    assert S.one_of_each(none).collect() == []


def test_query_against_all_pairs(spark):
    from tidecast.llm.queries import all_queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = [slow_print(d["text"]) for d in docs]
    want = slow_components([d["doc_id"] for d in docs], prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"])
           for r in all_queries()["op1_simhash_near_dedup"](spark, sf).collect()}
    assert got == {d["doc_id"]: (f"{p:016x}", w)
                   for d, p, w in zip(docs, prints, want, strict=True)}


def test_unlinked_texts_that_share_an_id_or_have_none_all_stay(spark):
    rows = [(None, "a river runs past the old mill"), (None, "nobody sold bread on that market"),
            (None, "nobody sold bread on that market"), (6, "winter came late to the northern hills"),
            (6, "three letters lay unread upon his desk"), (7, "Winter came late to the northern hills")]
    prints = sorted({slow_print(t) for _, t in rows})
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(prints) for b in prints[:i])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {(r["doc_id"], r["text"]) for r in S.one_of_each(df).collect()}
    assert kept == set(rows[:5]) and S.one_of_each(df).count() == 4


def test_a_large_shard_is_split_and_not_sent_to_every_tree(spark):
    r = random.Random(8)
    prints = [r.getrandbits(47) << 16 | 77 for _ in range(1500)]
    prints = sorted({*prints, *(p ^ (1 << 60) ^ (1 << 20) for p in prints[:200])})
    df = spark.createDataFrame([(p,) for p in prints], "bits long")
    placed = S.shards(df, tree_rows=50)
    assert placed.count() < 20 * len(prints)  # 34 trees for one of the four blocks alone before
    sizes = placed.where("own").groupBy("mask", "value", "tree").count().agg({"count": "max"})
    assert sizes.first()[0] <= 50
    roots = {r["node"]: r["root"] for r in S.components(S.near_links(df, tree_rows=50)).collect()}
    assert [roots.get(p, p) for p in prints] == slow_components(prints, prints)


def test_members_stream_past_a_tree():
    own, others = [1 << 40, 5 << 40], [(1 << 40) + 1 + i % 2 for i in range(90_000)]
    taken = 0

    def batches():
        nonlocal taken
        rows = [(x, True) for x in own] + [(x, False) for x in others]
        for at in range(0, len(rows), 1000):
            taken += 1
            bits, mine = zip(*rows[at:at + 1000], strict=True)
            key = {n: pa.array([0] * len(bits)) for n in ("mask", "value", "tree", "block")}
            yield pa.RecordBatch.from_pydict({**key, "bits": pa.array(bits), "own": pa.array(mine)})

    found = S._search(3)(batches())
    first = next(found)
    assert taken < 20 and first.num_rows <= 8192
    assert first.num_rows + sum(b.num_rows for b in found) == 1 + len(others)  # own ones are a class


# --- similar texts --------------------------------------------------------------------------


def similar_pairs(texts, n=5, least=0.8):
    """All pairs of ids whose texts have so many shingles in common, by an inverted index."""
    post, sizes = {}, {}
    for i, text in texts.items():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        found = {" ".join(w[k:k + n]) for k in range(max(len(w) - n + 1, 1))} if w else {""}
        sizes[i] = len(found)
        for x in found:
            post.setdefault(x, []).append(i)
    shared = Counter((a, b) for ids in post.values() for k, a in enumerate(ids) for b in ids[k + 1:])
    return [(a, b) for (a, b), k in shared.items() if k >= least * (sizes[a] + sizes[b] - k) - 1e-9]


def similar_classes(texts):
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in similar_pairs(texts):
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in texts}


def test_recall_of_similar_texts(spark):
    """Of all pairs of different texts 0.8 alike nine in ten are in one class, and no others."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").dropDuplicates(["text"])
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["root"] for r in S.similar_documents(docs).collect()}
    pairs, want = similar_pairs(rows), similar_classes(rows)
    assert len(pairs) > 40
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    classes = {}
    for i, root in got.items():
        classes.setdefault(root, set()).add(want[i])
    assert all(len(c) == 1 for c in classes.values())


def planted_copies():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(12):
        base = rng.choices(words, k=rng.choice([200, 300, 400]))
        for _ in range(25):
            some = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                some[rng.randrange(len(some))] = rng.choice(words)
            rows.append(" ".join(some))
    rows += ["", "", "one", "One", "two words", "x " * 50_000, "x " * 50_000 + "y", " ".join(words)]
    return dict(enumerate(rows))


def test_similar_texts_of_every_kind(spark, monkeypatch):
    monkeypatch.setattr(S, "SUB_BITS", 4)
    texts = planted_copies()
    rows = [(i, t, i) for i, t in texts.items()]
    rows += [(None, texts[0], 1), (500, None, 2), (3, texts[3], 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bits long")
    want = similar_classes(texts | {500: ""})
    for tree_rows in (4096, 8):
        kept = S.one_of_similar(df, tree_rows=tree_rows)
        assert kept.columns == df.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert S.one_of_similar(df.limit(0)).collect() == []


def test_forest_connects_what_all_pairs_connect():
    rng = random.Random(3)
    bases = [rng.getrandbits(128) for _ in range(6)]
    own = list({b ^ sum(1 << k for k in rng.sample(range(128), rng.randint(0, 16)))
                for b in bases for _ in range(30)})
    for radius in (6, 12, 20, 28):
        pairs = S.Forest(own, radius).pairs
        assert all(0 < (a ^ b).bit_count() <= radius for a, b in pairs)
        for limit in (radius, radius * 2 // 3):
            def classes(links):
                up = {x: x for x in own}

                def top(x):
                    while up[x] != x:
                        x = up[x]
                    return x

                for a, b in links:
                    up[top(a)] = top(b)
                return {frozenset(y for y in own if top(y) == top(x)) for x in own}

            every = [(a, b) for a in own for b in own if a < b and (a ^ b).bit_count() <= limit]
            assert classes(every) == classes([p for p in pairs if (p[0] ^ p[1]).bit_count() <= limit])


def test_classes_do_not_depend_on_how_a_shard_is_dealt(spark):
    """They are those of all similar pairs whose prints meet, found by brute force."""
    rng = random.Random(11)
    words, texts = [f"w{i}" for i in range(3000)], {}
    for _ in range(12):
        base = rng.choices(words, k=300)
        for _ in range(25):
            some = list(base)
            for _ in range(rng.randint(2, 5)):
                some[rng.randrange(len(some))] = rng.choice(words)
            texts[len(texts)] = " ".join(some)
    prints = {i: int.from_bytes(S.wide_print(t.encode()), "little") for i, t in texts.items()}
    masks = [sum(1 << int(k) for k in c) for c in S._choices(S.BANDS, S.BAND_BITS, 1)]
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in similar_pairs(texts):
        x = prints[a] ^ prints[b]
        if x.bit_count() <= S.wide_radius(S.SIMILARITY) and any(not x & m for m in masks):
            up[top(a)] = top(b)
    want = {frozenset(j for j in texts if top(j) == top(i)) for i in texts}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for tree_rows in (4096, 40, 6):
        classes = {}
        for r in S.similar_documents(df, tree_rows=tree_rows).collect():
            classes.setdefault(r["root"], set()).add(r["doc_id"])
        assert {frozenset(c) for c in classes.values()} == want


def test_verified_links_connect_what_all_similar_pairs_connect():
    rng, words = random.Random(4), 2
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))) for _ in range(80)]
    sets = [S.shingle_set(t.encode(), words) for t in texts]
    members = [(0, bytes([i // 2]), x.view("<i8")) for i, x in enumerate(sets)]

    def classes(pairs):
        up = list(range(40))
        for a, b in pairs:
            up = [up[b] if x == up[a] else x for x in up]
        return [up.index(x) for x in up]

    every = [(i // 2, j // 2) for i, x in enumerate(map(set, sets)) for j, y in enumerate(map(set, sets))
             if len(x & y) >= 0.5 * len(x | y)]
    found = [(a[0], b[0]) for a, b in S.links_between(members, 0, 0.5)]
    assert classes(found) == classes(every) and len(found) < 40
    far = [((1 << 40) - 1 if i % 2 else 0, root, x) for i, (_, root, x) in enumerate(members[:2])]
    assert list(S.links_between(far, 28, 0.0)) == []
