"""Per-document HTML helper for H1: one infobox HTML text -> one record per ``<tr>``.

This is the only Python in the infobox path; it runs inside ``mapInPandas``
tasks on Arrow batches and returns raw text pieces.  All rules (cleaning,
key/value/header/list decisions, sections, duplicate keys) are native Spark
expressions in ``kvlens.operators.infobox``.

Text is kept per text node, like a DOM's string list: ``<abbr title=t>``
becomes its own node ``t + ' '``, ``<img alt=a>`` becomes ``a``, and ``<i>``
is unwrapped without merging its text into the neighbours.
"""

from __future__ import annotations

from html.parser import HTMLParser

#: An opening tag closes an open one of the first set, unless one of the second set stands between.
_CLOSES = {
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "li": ({"li"}, {"ul", "ol", "table"}), "p": ({"p"}, {"td", "th", "table", "div", "li"}),
}
_VOID = {"br", "img", "hr", "meta", "link", "input", "col", "area", "base", "wbr", "source"}


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag = tag
        self.attrs = attrs
        self.children = []
        self.parent = parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", {}, None)
        self.cur = self.root

    def handle_starttag(self, tag, attrs):
        attrs = {k: (v or "") for k, v in attrs}
        if tag == "img":
            self.cur.children.append(attrs.get("alt", ""))
            return
        if tag in _CLOSES:
            own, within = _CLOSES[tag]
            open_ = self.cur
            while open_ is not self.root and open_.tag not in own and open_.tag not in within:
                open_ = open_.parent
            if open_.tag in own:
                self.cur = open_.parent
        node = _Node(tag, attrs, self.cur)
        self.cur.children.append(node)
        if tag not in _VOID:
            self.cur = node

    def handle_startendtag(self, tag, attrs):
        if tag == "img":
            self.cur.children.append({k: (v or "") for k, v in attrs}.get("alt", ""))
        else:
            self.cur.children.append(_Node(tag, {k: (v or "") for k, v in attrs}, self.cur))

    def handle_endtag(self, tag):
        node = self.cur
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.cur = node.parent

    def handle_data(self, data):
        self.cur.children.append(data)

    def handle_comment(self, data):
        # a DOM's string list holds comments too
        self.cur.children.append(data)


def _walk(node):
    """Children, their children and so on in document order, on a stack of
    its own (markup may nest thousands deep); nothing inside ``abbr``."""
    stack = [iter(node.children)]
    while stack:
        ch = next(stack[-1], None)
        if ch is None:
            stack.pop()
            continue
        yield ch
        if isinstance(ch, _Node) and ch.tag != "abbr":
            stack.append(iter(ch.children))


def _strings(node):
    """Text nodes under ``node`` in document order (abbr -> title + ' ';
    comment and script text included, as in a DOM's string list)."""
    return [ch if isinstance(ch, str) else ch.attrs.get("title", "") + " "
            for ch in _walk(node) if isinstance(ch, str) or ch.tag == "abbr"]


def _descendants(node, tags):
    return [ch for ch in _walk(node) if isinstance(ch, _Node) and ch.tag != "abbr" and ch.tag in tags]


def _has_fontweight(node) -> bool:
    stack = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            if "font-weight:" in n:
                return True
        elif any("font-weight:" in str(v) for v in n.attrs.values()):
            return True
        else:
            stack.extend(n.children)
    return False


def parse_table(html: str | None) -> tuple[list[str] | None, list[dict]]:
    """The caption's text pieces (None without one) and all ``<tr>`` (nested ones
    too, in document order)."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    caps = _descendants(b.root, {"caption"})
    rows = []
    for tr in _descendants(b.root, {"tr"}):
        ths = _descendants(tr, {"th"})
        tds = _descendants(tr, {"td"})
        td1 = tds[0] if tds else None
        td1_strings = _strings(td1) if td1 is not None else []
        rows.append(dict(
            n_th=len(ths), n_td=len(tds), n_text=len(_strings(tr)),
            has_nested=bool(_descendants(tr, {"table"})),
            th_pieces=_strings(ths[0]) if ths else [],
            td1_pieces=td1_strings,
            td2_pieces=_strings(tds[1]) if len(tds) > 1 else [],
            cell_pieces=[_strings(c) for c in _descendants(tr, {"th", "td"})],
            td1_bold=bool(td1 is not None and _descendants(td1, {"b"})),
            td1_fontweight=bool(td1 is not None and _has_fontweight(td1)),
            td1_first_text=td1_strings[0] if td1_strings else None,
            td1_class=(td1.attrs.get("class", "").split() or [None])[0] if td1 is not None else None,
        ))
    return (_strings(caps[0]) if caps else None), rows


ROW_SCHEMA = (
    "n_th: INT, n_td: INT, n_text: INT, has_nested: BOOLEAN, th_pieces: ARRAY<STRING>, "
    "td1_pieces: ARRAY<STRING>, td2_pieces: ARRAY<STRING>, cell_pieces: ARRAY<ARRAY<STRING>>, "
    "td1_bold: BOOLEAN, td1_fontweight: BOOLEAN, td1_first_text: STRING, td1_class: STRING"
)
TABLE_SCHEMA = f"table_id BIGINT, category STRING, caption ARRAY<STRING>, rows ARRAY<STRUCT<{ROW_SCHEMA}>>"


def tables_from_batches(batches):
    """``mapInArrow`` body: (table_id, category, html) -> with the caption and the rows."""
    import pyarrow as pa

    texts = pa.list_(pa.string())
    kinds = {"INT": pa.int32(), "BOOLEAN": pa.bool_(), "STRING": pa.string(), "ARRAY<STRING>": texts, "ARRAY<ARRAY<STRING>>": pa.list_(texts)}
    row = pa.struct([(name, kinds[kind]) for name, kind in (f.split(": ") for f in ROW_SCHEMA.split(", "))])
    schema = pa.schema([("table_id", pa.int64()), ("category", pa.string()), ("caption", texts), ("rows", pa.list_(row))])
    for batch in batches:
        for i in range(0, batch.num_rows, 256):  # few tables at a time: rows are many times their HTML
            part = batch.slice(i, 256)
            parsed = [parse_table(html) for html in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("table_id"), part.column("category"),
                                              pa.array([c for c, _ in parsed], texts), pa.array([r for _, r in parsed], pa.list_(row))], schema=schema)
