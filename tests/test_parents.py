from quarry.operators.parents import reconstructed

SCHEMA = "rank int, doc_id string, source_path string, source string, act string, section string, text string, paragraph_number int, paragraph_start int"


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def doc(text, doc_id=None, act="Act", section="1", path="a.md", number=None, start=None):
    return (doc_id, path, None, act, section, text, number, start)


def rows_of(df):
    return [(r.text, r.parent_reconstructed) for r in df.orderBy("rank").collect()]


def test_rows_without_a_section_stay(spark):
    rows = [doc("one", act=None, section=None), doc("two", act=None, section=None)]
    assert rows_of(reconstructed(table(spark, rows))) == [("one", False), ("two", False)]


def test_chunks_are_ordered_by_their_ids(spark):
    assert rows_of(reconstructed(table(spark, [doc("second", "a.md:1:x"), doc("first", "a.md:0:x")]))) == [("first\n\nsecond", True)]


def test_a_wider_pool_completes_a_section(spark):
    pool = table(spark, [doc("first", "a.md:0:x"), doc("second", "a.md:1:x"), doc("other", "a.md:2:x", section="2")])
    assert rows_of(reconstructed(pool.where("rank = 1"), pool)) == [("first\n\nsecond", True)]


def test_paragraph_numbers_come_before_ids_and_sources_stay_apart(spark):
    rows = [doc("b", "a.md:0:x", number=2), doc("a", "a.md:1:x", number=1), doc("c", "a.md:0:x", start=0), doc("z", "b.md:0:x", path="b.md")]
    assert rows_of(reconstructed(table(spark, rows))) == [("a\n\nb\n\nc", True), ("z", True)]
