import random
import re

from clickrank.llm import ngram_join as n

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, how):
    sets, parent = [], {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[j : j + how.width]) for j in range(max(1, len(w) - how.width + 1))) if w else frozenset())
        if i is not None:
            parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            (i, _), (j, _) = rows[a], rows[b]
            if i is None or j is None or not sets[a] or not sets[b]:
                continue
            if how.parts * len(sets[a] & sets[b]) >= how.least * len(sets[a] | sets[b]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((-1 if i is None else i, len(s), -1 if i is None else find(i)) for (i, _), s in zip(rows, sets))


def corpus(seed, families=6, members=12):
    """Families of edited copies around the threshold, chains, unrelated texts and a shared passage."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["the", "of"] * 10
    rows, i = [], 0
    passage = [r.choice(vocabulary) for _ in range(25)]
    for _ in range(families):
        base = [r.choice(vocabulary) for _ in range(r.randint(6, 90))]
        for m in range(members):
            words = list(base)
            for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
                words[r.randrange(len(words))] = r.choice(vocabulary + [f"rare{r.randrange(99)}"])
            if m % 3 == 0:
                base = words
            rows.append((i, " ".join(words).upper() if m % 4 == 0 else "  ".join(words)))
            i += 1
    for _ in range(15):
        rows.append((i, " ".join([r.choice(vocabulary) for _ in range(30)] + passage)))
        i += 1
    r.shuffle(rows)
    return rows


def ordered(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in df.collect())


def test_components_against_brute_force(table):
    for seed, how in ((1, n.Similarity(4, 85, 100)), (2, n.Similarity()), (3, n.Similarity(2, 60, 100))):
        rows = corpus(seed)
        assert ordered(n.jaccard_components(table(rows), how)) == brute(rows, how), seed


def test_defined_cases(table):
    how = n.Similarity(4, 85, 100)
    long = " ".join(f"v{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "b a"), (None, "a b"), (8, long), (9, long + " x"),
            (10, "p q r s t"), (10, "p q r s t"), (11, "p q r s t")]
    assert ordered(n.jaccard_components(table(rows), how)) == brute(rows, how)
    assert n.jaccard_components(table([]), how).count() == 0


def test_an_id_with_two_texts_links_both(table):
    rows = [(5, "a b c d e"), (5, "k l m n o"), (3, "k l m n o"), (7, "a b c d e")]
    found = n.jaccard_components(table(rows), n.Similarity(4, 85, 100))
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(5, 3), (3, 3), (7, 3)}


def test_hot_family_makes_few_pairs(table):
    """A family of edited copies is joined over its leader, not over all pairs."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join(base[:k] + [f"e{i}"] + base[k + 1 :])) for i in range(200) for k in [r.randrange(80)]]
    how = n.Similarity(4, 85, 100)
    assert ordered(n.jaccard_components(table(rows), how)) == brute(rows, how)


def test_one_of_each_group_stays(table):
    docs = table([(4, "a b c d e f"), (2, "a b c d e f"), (9, "x"), (None, "a b c d e f"), (1, None)])
    kept = n.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 1, 2, 9]


def brute_links(rows, how):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets.append((i, {tuple(w[j : j + how.width]) for j in range(max(1, len(w) - how.width + 1))} if w else set()))
    sets = [(i, s) for i, s in sets if i is not None and s]
    return {(i, j) for i, s in sets for j, u in sets if i < j and how.parts * len(s & u) >= how.least * len(s | u)}


def test_all_links_against_brute_force(table):
    r = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    hot = [(i, " ".join(base[:k] + [f"e{i}"] + base[k + 1 :])) for i in range(60) for k in [r.randrange(80)]]
    # id 500 has the texts of two classes; a member of one of them has no link over the other
    repeated = [(500, "a b c d e"), (500, "k l m n o"), (501, "a b c d e"), (502, "k l m n o"), (None, "a b c d e"), (503, "")]
    for rows, how in ((corpus(1), n.Similarity(4, 85, 100)), (hot + repeated, n.Similarity(4, 85, 100))):
        links, members = n.jaccard_links(table(rows), how)
        assert [(x.a, x.b) for x in n.document_links(links, members).collect() if x.a >= x.b] == []
        assert {(x.a, x.b) for x in n.document_links(links, members).collect()} == brute_links(rows, how)
    links, members = n.jaccard_links(table([]), how)
    assert links.count() == members.count() == 0
