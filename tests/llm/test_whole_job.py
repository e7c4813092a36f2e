"""Registered queries and operators over the whole of their input."""

from tallymark.llm import queries


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


# -- 10 ---------------------------------------------------------------------------------------------------------------
def test_units_are_lines_and_paragraphs_of_25_words(spark, tmp_path):
    line, short = " ".join(f"word{i}" for i in range(25)), "Subscribe to our newsletter"
    inner = ", ".join(" ".join(f"c{k}x{i}" for i in range(9)) for k in range(4))
    rows = [(1, f"first\n{line}\n{short}", "en", "s"), (2, f"second\n \n{line.upper()}\n{short}", "en", "s"), (3, f"before this. {inner}, and after", "en", "s"), (4, f"other words; {inner}, then the rest", "en", "s"), (5, f"{short}\n{line}", "en", "s")]
    rows += [(10 + i, f"{short}\nown text {i}", "en", "s") for i in range(20)]  # a line that most documents hold
    got = {r.doc_id: r.spans for r in queries.op10_line_dedup(spark, documents(spark, tmp_path, rows)).collect()}
    assert got == {i: "" for i, *_ in rows} | {2: f"9:{9 + len(line)}", 4: f"13:{13 + len(inner) + 1}", 5: f"28:{28 + len(line)}"}


def test_no_document_changes_because_others_come(spark, tmp_path):
    line = " ".join(f"word{i}" for i in range(30))
    few = [(i, f"{line}\n{i}", "en", "s") for i in range(3)]
    spans = lambda rows, at: {r.doc_id: r.spans for r in queries.op10_line_dedup(spark, documents(spark, at, rows)).collect()}
    alone = spans(few, tmp_path / "few")
    more = spans(few + [(100 + i, f"text {i} of another batch", "en", "s") for i in range(50)], tmp_path / "more")
    assert alone == {i: more[i] for i in alone} and sum(bool(x) for x in alone.values()) == 2


# -- 7 ----------------------------------------------------------------------------------------------------------------
def test_repeated_lines_and_tight_fences(spark, tmp_path):
    word = lambda i, k: f"w{i}x{k}"
    line = lambda i, j: " ".join(word(i, 8 * j + k) for k in range(8))
    clean = [(i, "\n".join(line(i, j) for j in range(6)), "en", "s") for i in range(20)]
    shared = (50, "\n".join(x for j in range(8) for x in (line(50, j), "Share this")), "en", "s")
    marked = (51, "\n".join(f"{line(51, j)} #" for j in range(6)), "en", "s")
    kept = {r.doc_id for r in queries.op7_quality_rules(spark, documents(spark, tmp_path, [*clean, shared, marked])).where("kept").collect()}
    assert kept == set(range(20))
