import re
from collections import defaultdict

from triptopics.llm import near_dup
from triptopics.llm.components import components


def brute(rows):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in rows:
        w = word.findall((t or "").translate(lower))
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    group = {d: d for d in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * len(sets[a] | sets[b]) and find(a) != find(b):
                group[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_edges_against_all_pairs(edge_docs, edge):
    rows = near_dup.near_duplicates(edge_docs).collect()
    want = brute([(d, t) for d, t, *_ in edge if d is not None])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in rows if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)] * 2
    assert want[2][1] == 1 and want[3][1] == 3 or want[3][1] == 1


def test_chain_of_near_copies(spark):
    """Neighbours are linked, distant members are not: one component all the same."""
    words = [f"w{k}" for k in range(100)]
    rows = []
    for step in range(12):
        w = list(words)
        for k in range(step):
            w[8 * k] = f"x{k}"
        rows.append((100 - step, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs).collect()}
    assert got == brute(rows)
    assert len({c for _, c in got.values()}) < len(rows)


def test_repeated_rows_and_empty(spark, no_docs):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A B c d e f g")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_dup.near_duplicates(no_docs).count() == 0


def test_keep_first_of_group(edge_docs):
    kept = near_dup.keep_first_of_group(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 8 not in ids and ids.count(None) == 2


def test_components_of_a_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(40)]
    star = [(1000, 1000 + k) for k in range(1, 60)]
    got = components(spark.createDataFrame(path + star + [(7, 7)], "a long, b long"))
    sizes = defaultdict(int)
    for r in got.collect():
        sizes[r.component] += 1
    assert dict(sizes) == {0: 41, 1000: 60}
