from collections import defaultdict

from corpusloom.llm import common, linededup


def brute(rows, max_docs):
    seen = defaultdict(set)

    def key(line):
        k = " ".join(line.split())
        return k.lower()

    for i, t in rows:
        for line in t.split("\n"):
            if key(line):
                seen[key(line)].add(i)
    return {i: "\n".join(x for x in t.split("\n") if not (key(x) and len(seen[key(x)]) > max_docs)) for i, t in rows}


ROWS = [
    (1, "All rights reserved here.\nunique one two three\nYes"),
    (2, "all  rights reserved  HERE.\nanother text of its own\nYes"),
    (3, "\tAll rights reserved here. \n\nthird text of its own\nYes\nAll rights reserved here."),
    (4, "twice one two three\ntwice one two three\ntwice one two three"),
    (5, "All rights reserved here."),
]


def test_like_brute_force(make):
    for max_docs in (1, 2, 3, 4):
        got = {r.doc_id: r.text for r in linededup.dedup_lines(make(ROWS), max_docs=max_docs).collect()}
        assert got == brute(ROWS, max_docs)


def test_counts_and_lengths(make):
    rows = {r.doc_id: r for r in linededup.dedup_lines(make(ROWS)).collect()}
    assert rows[3].lines_dropped == 3 and rows[3].n_chars == len(rows[3].text)
    assert rows[5].text == "" and rows[4].lines_dropped == 0


def test_shuffled_join_gives_the_same(make, monkeypatch):
    small = sorted(map(repr, linededup.dedup_lines(make(ROWS)).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert sorted(map(repr, linededup.dedup_lines(make(ROWS)).collect())) == small


def test_copies_are_spared(make):
    rows = [(i, "a copy of many lines\nwith a second line here") for i in range(5)] + [(9, "my own line stays here\na copy of many lines")]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(make(rows), spare_copies=True).collect()}
    assert all(got[i] == rows[i][1] for i in range(5))
    assert got[9] == "my own line stays here"


def test_repeated_rows_are_one_document(make):
    rows = [(1, "same line of text")] * 5
    assert {r.text for r in linededup.dedup_lines(make(rows)).collect()} == {"same line of text"}


def test_unspaced_passages_count(make):
    passages = ["本公司保留所有权利未经许可不得转载", "สงวนลิขสิทธิ์ตามกฎหมาย"]
    rows = [(i, f"own text number {i}\n" + "\n".join(passages)) for i in range(4)]
    assert {r.text for r in linededup.dedup_lines(make(rows)).collect()} == {f"own text number {i}" for i in range(4)}


def test_short_boilerplate_goes(make):
    rows = [(i, f"own text {i}\nRead more\nOK") for i in range(4)]
    assert {r.text for r in linededup.dedup_lines(make(rows)).collect()} == {f"own text {i}" for i in range(4)}


def test_near_copies_are_spared_and_mixtures_are_not(make):
    """Copies with one line in 12 changed stay whole; documents made of several boilerplate passages lose them."""
    own = [f"line {k} of the article that was copied" for k in range(12)]
    rows = [(i, "\n".join(x if k != i else f"changed by {i}" for k, x in enumerate(own))) for i in range(6)]
    passages = [[f"passage {p} line {k}" for k in range(4)] for p in range(6)]
    mixed = [(10 + i, "\n".join(passages[i % 6] + passages[(i + 1 + i // 6) % 6] + passages[(i + 3 + i // 6) % 6])) for i in range(12)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(make(rows + mixed), spare_copies=True).collect()}
    assert [got[i] for i in range(6)] == [t for _, t in rows]
    assert all(got[i] == "" for i, t in mixed if sum(t == u for _, u in mixed) == 1 and not overlapping(t, mixed))


def overlapping(text, rows):
    a = set(text.split("\n"))
    return any(u != text and len(a & set(u.split("\n"))) >= 0.7 * len(a | set(u.split("\n"))) for _, u in rows)


def test_a_line_in_every_document(make):
    """Also many times in each, and by many rows of one document."""
    rows = [(i, "\n".join(["shared by all"] * 50 + [f"own {i}"])) for i in range(300)] + [(1000, "rows of one\nown")] * 40
    docs = make(rows)
    got = linededup.dedup_lines(docs).collect()
    assert {r.text for r in got} == {f"own {i}" for i in range(300)} | {"rows of one\nown"}
    frequent = linededup.frequent_lines(linededup.line_hashes(docs)).collect()
    assert [r.n_docs for r in frequent] == [300]


def test_clashing_names(make):
    from pyspark.sql import functions as F

    docs = make(ROWS).withColumns({"_cl_h": F.lit("own"), "_CL_N": F.lit(7), "_cl_pos": F.lit("p"), "_cl_short": F.lit("s"), "a.b": F.lit("dot"), "lines_dropped": F.lit(-1)})
    got = linededup.dedup_lines(docs)
    assert got.columns == docs.columns
    assert {(r["_cl_h"], r["_CL_N"], r["_cl_pos"], r["_cl_short"], r["a.b"], r["lines_dropped"]) for r in got.collect()} == {("own", 7, "p", "s", "dot", -1)}
