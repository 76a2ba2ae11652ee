from hypothesis import given, settings
from hypothesis import strategies as st

from sparkweft.operators import chunking
from sparkweft.operators.chunking import blocks, chunk_documents, chunks, tokens


def test_short_paragraphs_share_a_chunk():
    assert [c[:] for c in chunks("# T\nintro\n\n\nsecond")] == [(0, 1, 5, 0, 6, "# T\nintro\n\nsecond", 4)]


def test_a_heading_opens_a_block_unless_the_block_begins_with_one():
    assert [b.first for b in blocks("text\n# one\n## two\nmore\n\n# three")] == [1, 2, 6]


def test_long_blocks_are_cut_between_lines():
    text = "\n".join(f"line {n} " + "x" * 100 for n in range(200))
    got = chunks(text)
    assert len(got) > 3 and all(c.token_est <= 1400 for c in got)
    assert "\n".join(c.text for c in got) == text
    assert [c.start_line for c in got[1:]] == [c.end_line + 1 for c in got[:-1]]


def test_a_single_line_may_exceed_the_limit():
    assert [c.token_est for c in chunks("y" * 7000)] == [2000]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 中\n#", max_size=300))
def test_no_solid_character_is_lost(text):
    got = chunks(text, target=10, most=14)
    solid = lambda t: "".join(t.split())
    assert "".join(solid(c.text) for c in got) == solid(text)
    assert [c.ordinal for c in got] == list(range(len(got)))
    assert all(c.token_est == tokens(c.text) for c in got)


def test_over_a_table(spark):
    df = spark.createDataFrame([(1, "a\n\nb"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r)[:4] for r in chunk_documents(df, "doc_id").collect()] == [(1, 0, 1, 3)]
    assert chunk_documents(df.limit(0), "doc_id").count() == 0
    assert [tuple(r) for r in chunking.document_blocks(df, "doc_id").collect()] == [(1, 1, 1, 1, 1), (1, 2, 3, 3, 1)]
