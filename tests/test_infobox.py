"""Infobox parsing on handmade HTML (FIXTURES.md section 1 cases)."""

from kvlens.operators import infobox as H

HTML = (
    '<table class="infobox"><caption>Ada <i>L.</i></caption>'
    '<tr><td class="infobox-image"><img alt="Ada portrait" src="a.png"/></td></tr>'
    '<tr><th>Born</th><td>10 Dec 1815<br/><span style="display:none">(1815-12-10)</span>London</td></tr>'
    '<tr><td><b>Known for</b></td><td>Notes<abbr title="circa">c.</abbr>1843</td></tr>'
    '<tr><td style="font-weight:bold">Spouse</td><td>William</td></tr>'
    '<tr><td>Field:</td><td>maths</td></tr>'
    '<tr><td>no colon</td><td>ignored</td></tr>'
    '<tr><th>Born</th><td>later value</td></tr>'
    '<tr><th colspan="2">Family</th></tr>'
    '<tr><th>Father</th><td>Byron</td></tr>'
    '<tr><td colspan="2">&bull; first&nbsp;item :</td></tr>'
    '<tr><td colspan="2"><table><tr><th>Inner</th><td>x</td></tr></table></td></tr>'
    '<tr><td><b>Works</b></td></tr>'
    '<tr><td>Sketch</td></tr>'
    '<tr><th>  </th></tr>'
    '<tr><th>Top</th><td>after blank header</td></tr>'
    '<tr><th colspan="2">Empty</th></tr>'
    '</table>'
)


def test_key_values_cases(spark):
    tables = spark.createDataFrame([(1, "person", HTML)], "table_id long, category string, html string")
    kv = H.key_values(tables).orderBy("ord", "sub_ord", "list_pos").collect()
    got = [(r.section, r.key, r.value, r.list_pos, r.kind) for r in kv]
    assert got == [
        (None, "category", "person", None, "flat"),
        (None, "caption", "Ada | L.", None, "flat"),
        (None, "infobox-image", "Ada portrait", None, "flat"),
        (None, "Born", "later value", None, "flat"),        # later write wins, first position kept
        (None, "Known for", "Notes | circa | 1843", None, "flat"),  # abbr -> title, own node
        (None, "Spouse", "William", None, "flat"),          # 'font-weight:' first cell
        (None, "Field", "maths", None, "flat"),             # colon-ended first cell
        ("Family", "Father", "Byron", None, "section_kv"),
        ("Family", "Inner", "x", None, "section_kv"),       # nested table's own row
        ("Family", "Family", " first item", 1, "section_list"),  # bullet/nbsp -> spaces, lead kept
        ("Works", "Works", "Sketch", 1, "section_list"),    # bold single cell opens a section
        (None, "Top", "after blank header", None, "flat"),  # blank header closed the section
        ("Empty", None, None, None, "empty_section"),       # written at table end, even if empty
    ]


def test_linearise_text(spark):
    tables = spark.createDataFrame([(1, "person", HTML)], "table_id long, category string, html string")
    text = H.linearise(H.nested(tables)).collect()[0].text
    assert text.startswith("category\nperson\n\ncaption\nAda | L.\n\n")
    assert "Family\nFather\tByron\nInner\tx\n[' first item']\n\n" in text
    assert text.endswith("Empty\n\n")


def test_read_documents_roundtrip(spark):
    tables = spark.createDataFrame([(1, "person", HTML)], "table_id long, category string, html string")
    kv = H.key_values(tables)
    docs = H.document_json(H.nested(tables))
    back = H.read_documents(docs)
    a = sorted(map(repr, ((r.section, r.key, r.value, r.list_pos, r.kind) for r in kv.collect())))
    b = sorted(map(repr, ((r.section, r.key, r.value, r.list_pos, r.kind) for r in back.collect())))
    assert a == b
    assert H.linearise(H.nested(tables)).collect()[0].text == H.linearise(H.nested_documents(docs)).collect()[0].text


def test_comment_text_counts_as_a_piece(spark):
    html = '<table><tr><th>Key<!--note--></th><td>v</td></tr></table>'
    tables = spark.createDataFrame([(2, "c", html)], "table_id long, category string, html string")
    got = {(r.key, r.value) for r in H.key_values(tables).collect() if r.kind == "flat"}
    assert ("Key | note", "v") in got
