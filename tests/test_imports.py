"""Imports: identities in turn, what is kept and restored, and conflicts."""

from noticeweave.operators import imports as I

KIND = "id int, school int, department int, title string, url string, published_at date, created_at date, summary string, body_text string, body_html string, hash string"


def notice(ident, *, url="u", title="T", school=1, department=1, published=None, summary=None, text=None, html=None, digest=None):
    import datetime as dt

    return (ident, school, department, title, url, published and dt.date.fromisoformat(published), None, summary, text, html, digest)


def merged(spark, current, incoming):
    rows = I.merged_notices(spark.createDataFrame(current, KIND), spark.createDataFrame(incoming, KIND)).collect()
    return {r.kept: (r.added, r.copies, r.restored, r.title, str(r.published_at), r.summary, r.body_text, r.body_html) for r in rows}


def test_current_values_stay_and_missing_ones_come(spark):
    got = merged(spark, [notice(1, title="Old", text="")], [notice(9, title="New", summary="s9", html="<p>"), notice(8, summary="", text="t8", published="2024-01-01"), notice(7, department=5)])
    assert got == {1: (False, 3, True, "Old", "2024-01-01", "s9", "t8", None)}  # one body as a whole, of the first row that has one
    assert merged(spark, [notice(1, text="mine", summary="mine")], [notice(2, text="x", html="y", summary="z")]) == {1: (False, 1, False, "T", "None", "mine", "mine", None)}


def test_identities_in_turn(spark):
    current = [notice(1, url="", published="2024-01-01"), notice(2, url="", title="U", text="b"), notice(3, url="a"), notice(4, url="a", title="twin")]
    incoming = [
        notice(10, url="", published="2024-01-01"), notice(11, url="", published="2024-01-02"), notice(12, url="", title="U", text="b", html=""), notice(13, url=None, title="U", text="other"),
        notice(14, url="a", title="any"), notice(15, url="a", school=2), notice(16, url="", title="U", digest="d"), notice(17, url="", title="U", text="zzz", digest="d"),
    ]
    got = {k: v[:2] for k, v in merged(spark, current, incoming).items()}
    assert got == {1: (False, 1), 11: (True, 1), 2: (False, 1), 13: (True, 1), 3: (False, 1), 4: (False, 0), 15: (True, 1), 16: (True, 2)}
    found = I.import_map(spark.createDataFrame(current, KIND), spark.createDataFrame(incoming, KIND)).collect()
    assert {r.id: (r.kept, r.added) for r in found} == {10: (1, False), 11: (11, True), 12: (2, False), 13: (13, True), 14: (3, False), 15: (15, True), 16: (16, True), 17: (16, True)}


def test_empty(spark):
    assert merged(spark, [], []) == {}
    assert set(merged(spark, [notice(1)], [])) == set(merged(spark, [], [notice(1)])) == {1}


def test_titles_are_only_corrected_by_witnessed_variants(spark):
    current = spark.createDataFrame([notice(1, title="Date T"), notice(2, url="v"), notice(3, url="")], KIND)
    rows = [(1, "u", 1, 2, "T", ["Date T"]), (1, "u", 1, 3, "Z", ["Date T"]), (1, "u", 2, 1, "X", ["Date T"]), (1, "v", 1, 1, "Y", ["other"]), (1, "", 1, 1, "W", ["T"])]
    listed = spark.createDataFrame(rows, "school int, url string, department int, nth int, title string, variants array<string>")
    assert [(r.id, r.title) for r in I.retitled(current, listed).collect()] == [(1, "T")]


def test_schools_with_names_in_common_are_conflicts(spark):
    names = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (3, "c"), (4, "e")], "school int, name string")
    incoming = spark.createDataFrame([(x,) for x in ("a", "b", "c", "d", "e", "f", "f")], "name string")
    got = {r.name: (r.school, r.state) for r in I.school_identities(incoming, names).collect()}
    assert got == {"a": (1, "known"), "b": (1, "known"), "c": (None, "conflict"), "d": (None, "conflict"), "e": (4, "known"), "f": (None, "new")}
