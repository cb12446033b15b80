"""Workbooks (XLSX) with the standard library: a reader of cells and a writer into templates.

``spark.read.format("workbook")`` gives one row for each cell that has a value: path, sheet, row,
col, kind (num, str, bool, error, formula_num, formula_str, formula_error, formula_empty,
formula_bool), num, text. Formula cells carry the result that is stored with them.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from gradeline.shipping import ship
from gradeline.sources.constants import SECTIONS

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
SCHEMA = "path string, sheet string, row int, col string, kind string, num double, text string"
_CELL, _ROW, _VALUE, _FORMULA = f"{_MAIN}c", f"{_MAIN}row", f"{_MAIN}v", f"{_MAIN}f"
_REF = re.compile(r"([A-Z]+)(\d+)")


def _texts(node) -> str:
    """The joined text of a plain or rich string."""
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def sheet_files(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet names with their parts of the archive."""
    return dict(_sheet_parts(book.read("xl/_rels/workbook.xml.rels"), book.read("xl/workbook.xml")))


@lru_cache(maxsize=64)
def _sheet_parts(relations: bytes, workbook: bytes) -> tuple[tuple[str, str], ...]:
    """Sheet names with their parts, of a workbook's list of sheets and its relations, which are the same in many workbooks."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(relations).iter(f"{_PACKAGE}Relationship")}
    sheets = ElementTree.fromstring(workbook).iter(f"{_MAIN}sheet")
    return tuple({s.get("name"): "xl/" + targets[s.get(f"{_REL}id")].removeprefix("/xl/") for s in sheets}.items())


@dataclass(frozen=True)
class Wanted:
    """What of a workbook is read: sheets by name (None: all) and rows from first to last."""

    sheets: frozenset[str] | None = None
    first: int = 1
    last: int = 1 << 31

    def of_sheets(self, names) -> Wanted:
        return replace(self, sheets=frozenset(names) if self.sheets is None else self.sheets & frozenset(names))

    def rows(self, first: int | None = None, last: int | None = None) -> Wanted:
        return replace(self, first=max(self.first, first or 1), last=min(self.last, self.last if last is None else last))


def cells_of(data: bytes, path: str = "", wanted: Wanted = Wanted()) -> Iterator[tuple]:
    """Rows of SCHEMA for each filled cell; other sheets than those wanted are not unpacked."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_texts(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        for sheet, part in sheet_files(book).items():
            if wanted.sheets is not None and sheet not in wanted.sheets:
                continue
            for node in _cell_nodes(book.read(part)):
                col, row = _REF.fullmatch(node.get("r")).groups()
                row = int(row)
                if not wanted.first <= row <= wanted.last:
                    continue
                value, formula = node.find(_VALUE), node.find(_FORMULA)
                kind, num, text = _decoded(node, value, shared)
                if formula is not None:
                    kind = f"formula_{kind or 'empty'}"
                if kind:
                    yield path, sheet, row, col, kind, num, text


#: Sheets of more bytes are read cell by cell, others at once.
_WHOLE_SHEET = 8 << 20


def _cell_nodes(data: bytes) -> Iterator:
    """The cells of a sheet."""
    if len(data) <= _WHOLE_SHEET:
        yield from ElementTree.fromstring(data).iter(_CELL)
        return
    for _, node in ElementTree.iterparse(io.BytesIO(data)):
        if node.tag == _CELL:
            yield node
        if node.tag in (_CELL, _ROW):
            node.clear()


def _decoded(node, value, shared: list[str]):
    form = node.get("t", "n")
    if form == "inlineStr":
        return "str", None, _texts(node)
    if value is None or value.text is None:
        return "", None, None
    if form == "s":
        return "str", None, shared[int(value.text)]
    if form == "b":
        return "bool", None, "true" if value.text == "1" else "false"
    if form == "e":
        return "error", None, value.text
    if form in ("str", "d"):
        return "str", None, value.text
    return "num", float(value.text), None


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    """One partition for each file; filters on sheet and row reach the files' parts."""

    def __init__(self, paths: list[str]):
        self.paths = paths
        self.wanted = Wanted()

    def pushFilters(self, filters):
        for f in filters:
            name = getattr(f, "attribute", ())
            if name == ("sheet",) and isinstance(f, EqualTo):
                self.wanted = self.wanted.of_sheets([f.value])
            elif name == ("sheet",) and isinstance(f, In):
                self.wanted = self.wanted.of_sheets(f.value)
            elif name == ("row",) and isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan, LessThanOrEqual, LessThan)):
                above, below = isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)), isinstance(f, (EqualTo, LessThanOrEqual, LessThan))
                self.wanted = self.wanted.rows(f.value + isinstance(f, GreaterThan) if above else None, f.value - isinstance(f, LessThan) if below else None)
            else:
                yield f

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            yield from cells_of(f.read(), partition.path, self.wanted)


class WorkbookSource(DataSource):
    """Files of a folder or single files on a mounted file system; for other stores use ``read_cells``."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        import glob
        import os

        path = self.options["path"].removeprefix("file://")
        return _Reader(sorted(glob.glob(os.path.join(path, "**", "*.xlsx"), recursive=True)) if os.path.isdir(path) else [path])


def register(spark: SparkSession) -> None:
    """Make the format known; its filters on sheet and row are pushed down to the files."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)


def contents_cells(contents: DataFrame, wanted: Wanted = Wanted()) -> DataFrame:
    """Cells of workbooks that are held as (path, content)."""
    ship(contents.sparkSession)

    def run(batches):
        for batch in batches:
            yield from _cells_of_books(zip(batch.column("path").to_pylist(), (c.as_py() for c in batch.column("content")), strict=True), wanted)

    return contents.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, SCHEMA)


#: So many bytes of sheets are read at a time.
_AT_ONCE = 4 << 20
_ROWS_BEGIN, _ROWS_END = b"<sheetData>", b"</sheetData>"
_STYLE, _TAIL = r'^(?: s="[0-9]+")?', r"(?:</row>|<row [^<>]*>)*$"
_OWN_FORMULA = r"<f(?: [^<>]*)?(?:/>|>[^<>]*</f>)"
#: What follows a plain cell's reference: a number, perhaps with its formula, an inline text, a formula without a result, nothing.
_NUMBER = rf"{_STYLE}>(?:{_OWN_FORMULA})?<v>-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?</v></c>{_TAIL}"
_TEXT = rf'{_STYLE} t="inlineStr"><is><t(?: xml:space="preserve")?>(?:[^<>&\x00-\x08\x0b-\x1f]|&(?:amp|lt|gt|quot|apos);)*</t></is></c>{_TAIL}'
_EMPTY_FORMULA, _NOTHING = rf"{_STYLE}>{_OWN_FORMULA}</c>{_TAIL}", rf"{_STYLE}(?: ?/>|></c>){_TAIL}"
_KINDS = ("num", "formula_num", "str", "formula_empty")


def _cells_of_books(books: Iterable[tuple[str, bytes]], wanted: Wanted) -> Iterator:
    """Record batches of SCHEMA: plain sheets, many at a time, by columns; the others by ``cells_of``."""
    held, size = [], 0
    for path, content in books:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            if "xl/sharedStrings.xml" in book.namelist():
                yield from _as_batch(cells_of(content, path, wanted))
                continue
            for sheet, part in _sheet_parts(book.read("xl/_rels/workbook.xml.rels"), book.read("xl/workbook.xml")):
                if wanted.sheets is not None and sheet not in wanted.sheets:
                    continue
                data = book.read(part)
                rows = _plain_rows(data)
                if rows is None:
                    yield from _as_batch(cells_of(content, path, wanted.of_sheets([sheet])))
                    continue
                held.append((path, sheet, content, rows))
                size += len(rows)
        if size >= _AT_ONCE:
            yield from _held_cells(held, wanted)
            held, size = [], 0
    yield from _held_cells(held, wanted)


def _as_batch(rows: Iterable[tuple]) -> Iterator:
    """Rows of SCHEMA as a record batch, if there are any."""
    import pyarrow as pa

    columns = list(zip(*rows, strict=True))
    if columns:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "sheet", "row", "col", "kind", "num", "text"])


def _plain_rows(data: bytes) -> bytes | None:
    """The rows of a sheet as they are written; None if the sheet is large or what surrounds them is not plain."""
    begin, end = data.find(_ROWS_BEGIN), data.rfind(_ROWS_END)
    if len(data) > _WHOLE_SHEET or not 0 <= begin < end or begin + len(data) - end > 1 << 16:
        return None
    begin += len(_ROWS_BEGIN)
    return data[begin:end] if _plain_frame(data[:begin], data[end:]) else None


@lru_cache(maxsize=64)
def _plain_frame(before: bytes, after: bytes) -> bool:
    """Whether a sheet without its rows is plain: in UTF-8, of the main namespace, without comments, entities or cells elsewhere."""
    if b"<!" in before + after or re.match(rb"""\s*<\?xml[^>]*encoding=["'](?!utf-8["'])""", before, re.IGNORECASE):
        return False
    root = ElementTree.fromstring(before + after)
    return root.tag == f"{_MAIN}worksheet" and root.find(f"{_MAIN}sheetData") is not None and root.find(f".//{_CELL}") is None


def _held_cells(held: list[tuple[str, str, bytes, bytes]], wanted: Wanted) -> Iterator:
    """The cells of sheets (path, sheet, content, rows); those with cells that are not plain are read by ``cells_of``."""
    import pyarrow as pa

    if not held:
        return
    try:
        made, odd = _plain_cells(held, wanted)
    except pa.ArrowInvalid:  # no UTF-8, or a number out of range
        made, odd = None, range(len(held))
    if made is not None and made.num_rows:
        yield made
    for i in odd:
        path, sheet, content, _ = held[i]
        yield from _as_batch(cells_of(content, path, wanted.of_sheets([sheet])))


def _plain_cells(held: list[tuple[str, str, bytes, bytes]], wanted: Wanted):
    """A record batch of the cells of all sheets that are plain throughout, and the numbers of the others."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    matches = lambda x, pattern: pc.match_substring_regex(x, pattern).to_numpy(zero_copy_only=False)
    after = lambda x, mark, **how: pc.list_element(pc.split_pattern(x, mark, max_splits=1, **how), 1)
    until = lambda x, mark: pc.list_element(pc.split_pattern(x, mark, max_splits=1), 0)
    pieces = pc.split_pattern(pa.array([rows for *_, rows in held], pa.binary()).cast(pa.string()), '<c r="')
    begins = pieces.offsets.to_numpy()[:-1]
    sheet_of, pieces = pc.list_parent_indices(pieces).to_numpy(), pieces.flatten()
    is_cell = np.ones(len(pieces), bool)
    is_cell[begins] = False
    odd = set(np.flatnonzero(~matches(pieces.take(begins), f"^{_TAIL}")).tolist())
    cells, sheet_of = pieces.filter(is_cell), sheet_of[is_cell]
    if not len(cells):
        return None, odd
    split = pc.split_pattern(cells, '"', max_splits=1)
    ref, rest = pc.list_element(split, 0).dictionary_encode(), pc.list_element(split, 1)
    places = [_REF.fullmatch(r) for r in ref.dictionary.to_pylist()]
    at = ref.indices.to_numpy()
    row = np.array([int(p[2]) if p else 0 for p in places], np.int64)[at]
    is_num, is_text = matches(rest, _NUMBER), matches(rest, _TEXT)
    left = np.flatnonzero(~(is_num | is_text))
    others = rest.take(left)
    is_formula, known = np.zeros(len(rest), bool), is_num | is_text
    is_formula[left] = matches(others, _EMPTY_FORMULA)
    known[left] = is_formula[left] | matches(others, _NOTHING)
    odd |= set(np.unique(sheet_of[~known | ~np.array([p is not None for p in places], bool)[at]]).tolist())
    keep = (is_num | is_text | is_formula) & (row >= wanted.first) & (row <= wanted.last) & ~np.isin(sheet_of, list(odd))
    rest, sheet_of, row, at, is_num, is_text, is_formula = rest.filter(keep), sheet_of[keep], row[keep], at[keep], is_num[keep], is_text[keep], is_formula[keep]

    def spread(values, there):
        """Values of some cells as a column of all."""
        return values.take(pa.array(np.cumsum(there) - 1, mask=~there))

    numbers, texts = rest.filter(is_num), rest.filter(is_text)
    with_formula = np.zeros(len(rest), bool)
    with_formula[is_num] = matches(numbers, rf"{_STYLE}><f")
    num = until(after(numbers, "<v>"), "<").cast(pa.float64())
    text = after(until(texts, "</t>"), ">", reverse=True)
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = pc.replace_substring(text, entity, sign)
    kind = pa.array(_KINDS).take(pa.array(np.where(is_num, with_formula, np.where(is_text, 2, 3)).astype(np.int32)))
    path, sheet = (pa.array(x, pa.string()).take(pa.array(sheet_of)) for x in list(zip(*held, strict=True))[:2])
    col = pa.array([p[1] if p else None for p in places], pa.string()).take(pa.array(at))
    columns = [path, sheet, pa.array(row).cast(pa.int32()), col, kind, spread(num, is_num), spread(text, is_text)]
    return pa.RecordBatch.from_arrays(columns, names=["path", "sheet", "row", "col", "kind", "num", "text"]), sorted(odd)


def read_cells(spark: SparkSession, root: str, wanted: Wanted = Wanted()) -> DataFrame:
    """Cells of all workbooks below a folder of any file system that Spark reads; Spark deals the files to tasks by their sizes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(root)
    return contents_cells(files, wanted)


def decoded(cells: DataFrame, strict: bool = True) -> DataFrame:
    """Cells as (num, text) values: stored formula results count, errors count as empty (or as their text, if not strict)."""
    wrong = F.col("kind").isin("error", "formula_error")
    text = F.when(wrong, None if strict else F.col("text")).otherwise(F.col("text"))
    return cells.select("path", "sheet", "row", "col", "num", text.alias("text")).where("num is not null or text is not null")


def section_rows(cells: DataFrame, by: str = "path", sections=SECTIONS) -> DataFrame:
    """(by, section, ord, row, key, column, column_name, num, text): the compared cells of rows with a key.

    ``row`` is the first row of the section plus the row's place among those with a key. All cells are dealt and sorted once: the
    rows of a section come in turn, and each cell sees how many keys there are up to its row, and the last of them.
    """
    from pyspark.sql import Window

    table = [(i, j, s, sheet, first, last, key, c, n) for i, (s, sheet, first, last, key, columns) in enumerate(sections) for j, (c, n) in enumerate(columns.items())]
    schema = "_section int, _column int, section string, sheet string, first int, last int, key_col string, col string, column_name string"
    spec = cells.sparkSession.createDataFrame(table, schema).coalesce(1)
    inside = cells.where(F.col(by).isNotNull()).join(F.broadcast(spec), ["sheet", "col"]).where(F.col("row").between(F.col("first"), F.col("last")))
    has_key = (F.col("col") == F.col("key_col")) & ~(F.coalesce(F.col("num") == 0, F.lit(False)) | F.coalesce(F.col("text") == "", F.lit(False)))
    key = F.coalesce("text", F.regexp_replace(F.col("num").cast("string"), r"\.0$", ""))
    narrow = inside.select(by, "_section", "_column", F.col("row").alias("_row"), "num", "text", F.when(has_key, F.struct(F.col("row").alias("row"), key.alias("key"))).alias("_key"))
    upto = Window.partitionBy(by, "_section").orderBy("_row")  # whole rows: the cells of a row are peers
    seen = narrow.withColumns({"_last": F.last("_key", ignorenulls=True).over(upto), "ord": F.count("_key").over(upto).cast("int")}).where(F.col("_last.row") == F.col("_row"))
    named = seen.join(F.broadcast(spec.select("_section", "_column", "section", "first", "col", "column_name")), ["_section", "_column"])
    return named.select(by, "section", F.col("_last.key").alias("key"), "ord", (F.col("first") + F.col("ord") - 1).alias("row"), F.col("col").alias("column"), "column_name", "num", "text")


def row_range(cells: DataFrame, sheet: str, first: int, last: int) -> DataFrame:
    return cells.where((F.col("sheet") == sheet) & F.col("row").between(first, last))


def dataset_cell(num: Column, default: float = 0.0) -> Column:
    """A number of the ground-truth dataset, where an empty cell is a default."""
    return F.coalesce(num, F.lit(default))


def filled_template(template: bytes, writes: list[tuple[str, str, float | None, str | None, bool]]) -> bytes:
    """The template with (sheet, ref, num, text, force) written; formulas stay unless a write is forced."""
    import pyarrow as pa

    if not writes:
        return _filler(template).zipped({})
    sheet, ref, num, text, force = zip(*writes, strict=True)
    name = pa.array([f"{s}!{r}" for s, r in zip(sheet, ref, strict=True)], pa.string())
    columns = [pa.nulls(len(writes), pa.string()), name, pa.array(num, pa.float64()), pa.array(text, pa.string()), pa.array(force, pa.bool_())]
    return _filler(template).filled(pa.RecordBatch.from_arrays(columns, names=["project", "name", "num", "text", "force"]))["content"][0].as_py()


@lru_cache(maxsize=4)
def _prepared(template: bytes) -> tuple[list[tuple[str, bytes]], dict[str, tuple[str, _Sheet]]]:
    """The parts of a template, and its sheets by part, each with its name; made once for all workbooks of a task."""
    ElementTree.register_namespace("", _MAIN[1:-1])
    parts = []
    with zipfile.ZipFile(io.BytesIO(template)) as book:
        for item in book.namelist():
            data = book.read(item)
            if item == _CHAIN:  # it lists formula cells, some of which are numbers from now on; programs make it again
                continue
            parts.append((item, _without_chain(data) if item in ("xl/_rels/workbook.xml.rels", "[Content_Types].xml") else data))
        held = dict(parts)
        return parts, {part: (name, _Sheet(held[part])) for name, part in sheet_files(book).items() if part in held}


_CHAIN = "xl/calcChain.xml"


def _without_chain(data: bytes) -> bytes:
    """A list of relations or content types without the calculation chain's."""
    root = ElementTree.fromstring(data)
    for node in list(root):
        if (node.get("Target") or node.get("PartName") or "").endswith("calcChain.xml"):
            root.remove(node)
    space = root.tag[1 : root.tag.index("}")]
    text = ElementTree.tostring(root, encoding="unicode").replace("ns0:", "").replace("xmlns:ns0=", "xmlns=")
    return f'<?xml version="1.0" encoding="UTF-8"?>{text}'.encode() if space else data


def new_workbook(sheets: dict[str, dict[str, str | float | tuple]]) -> bytes:
    """A workbook of cells by reference: a number, a text, ("formula", text) or ("shared", index, range and text or two None) of a shared formula."""

    def cell(ref: str, value) -> str:
        if isinstance(value, str):
            return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
        if not isinstance(value, tuple):
            return f'<c r="{ref}"><v>{float(value)!r}</v></c>'
        if value[0] == "formula":
            return f'<c r="{ref}"><f>{escape(value[1])}</f></c>'
        _, index, area, text = value
        return f'<c r="{ref}"><f t="shared" si="{index}"' + (f' ref="{area}">{escape(text)}</f></c>' if text else "/></c>")

    def body(cells: dict) -> str:
        rows: dict[int, list] = {}
        for ref, value in cells.items():
            col, row = _REF.fullmatch(ref).groups()
            rows.setdefault(int(row), []).append((_column_number(col), cell(ref, value)))
        return "".join(f'<row r="{r}">{"".join(c for _, c in sorted(rows[r]))}</row>' for r in sorted(rows))

    names = list(sheets)
    head, main, office = '<?xml version="1.0" encoding="UTF-8"?>', _MAIN[1:-1], _REL[1:-1]
    types = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{types}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{types}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_PACKAGE[1:-1]}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PACKAGE[1:-1]}">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, n in enumerate(names, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{body(sheets[n])}</sheetData></worksheet>')
    return out.getvalue()


def _column_number(col: str) -> int:
    n = 0
    for c in col:
        n = n * 26 + ord(c) - 64
    return n


def _as_xml(node) -> str:
    """A part of a sheet as text, in the sheet's namespace."""
    node.tail = None
    return ElementTree.tostring(node, encoding="unicode").replace(f' xmlns="{_MAIN[1:-1]}"', "")


def _head_xml(node) -> str:
    """The start of an element, without its end."""
    bare = ElementTree.Element(node.tag, node.attrib)
    return _as_xml(bare).removesuffix(" />")


_MARK = "gradeline-rows"


class _Sheet:
    """A template's sheet as text, with its rows and cells apart."""

    def __init__(self, data: bytes):
        from gradeline.operators.layout import expanded_formulas

        root = ElementTree.fromstring(data)
        body = root.find(f"{_MAIN}sheetData")
        cells = {c.get("r"): c for r in body for c in r}
        self._own_formulas(cells, expanded_formulas)
        self.rows = {int(r.get("r")): _head_xml(r) for r in body}
        #: What a cell is if it is left alone, and how it starts if it is written.
        self.cells, self.heads = {ref: _as_xml(c) for ref, c in cells.items()}, {}
        self.fixed = {ref for ref, c in cells.items() if c.find(_FORMULA) is not None}
        for ref, c in cells.items():
            c.attrib.pop("t", None)
            self.heads[ref] = _head_xml(c)
        for node in list(body):
            body.remove(node)
        body.text = _MARK
        self.before, self.after = ElementTree.tostring(root, encoding="unicode").split(_MARK)

    @staticmethod
    def _own_formulas(cells: dict, expand) -> None:
        """Each cell of a shared formula gets a formula of its own, so that one can be replaced."""
        shared: dict[str, dict] = {}
        groups: dict[str, str] = {}
        for ref, c in cells.items():
            f = c.find(_FORMULA)
            if f is None:
                continue
            if f.get("t") == "shared" and f.text:
                groups[f.get("si")] = ref
                shared[ref] = {"formula": f.text}
            elif f.get("t") != "shared" and f.text:
                shared[ref] = {"formula": f.text}
        for ref, c in cells.items():
            f = c.find(_FORMULA)
            if f is not None and f.get("t") == "shared" and not f.text:
                shared[ref] = {"shared": groups.get(f.get("si"), "")}
        for ref, formula in expand(shared).items():
            f = cells[ref].find(_FORMULA)
            for a in ("t", "si", "ref"):
                f.attrib.pop(a, None)
            f.text = formula


#: So many places of cells are remembered.
_MOST_PLACES = 1 << 18


class _Filler:
    """Fills a template for many projects at a time: the texts of cells are made by columns and put in the sheets' order by places.

    A place is a cell of a sheet. Those of the template come first, with its rows as cells of column 0; places of further
    cells are added as they are met.
    """

    def __init__(self, template: bytes):
        import pyarrow as pa

        self.parts, sheets = _prepared(template)
        self.sheets = [(part, name, sheet) for part, (name, sheet) in sheets.items()]
        self.numbers = {name: i for i, (_, name, _) in enumerate(self.sheets)}
        self.frames = [(f"<?xml version='1.0' encoding='UTF-8'?>\n{s.before}".encode(), f"</row>{s.after}".encode()) for *_, s in self.sheets]
        self.packed = {part: _packed(data) for part, data in self.parts}
        own = []
        for i, (_, _, s) in enumerate(self.sheets):
            own += [((i, row, 0), "", "") for row in s.rows]
            own += [(self._spot(i, ref), ref, xml) for ref, xml in s.cells.items()]
        self.own = [(spot, ref) for spot, ref, _ in own]
        self.own_xml = pa.array([xml for *_, xml in own], pa.string())
        self._forget()

    @staticmethod
    def _spot(sheet: int, ref: str) -> tuple[int, int, int]:
        col, row = _REF.fullmatch(ref).groups()
        return sheet, int(row), _column_number(col)

    def _forget(self) -> None:
        self.spots, self.refs, self.known = [spot for spot, _ in self.own], [ref for _, ref in self.own], {}
        self.known = {f"{self.sheets[spot[0]][1]}!{ref}": at for at, (spot, ref) in enumerate(self.own) if ref}
        self.arranged = 0

    def _place(self, name: str) -> int:
        """The place of a cell "sheet!reference", -1 on a sheet that the template lacks."""
        at = self.known.get(name)
        if at is None:
            sheet, _, ref = name.rpartition("!")
            at = -1
            if sheet in self.numbers:
                at = len(self.spots)
                self.spots.append(self._spot(self.numbers[sheet], ref))
                self.refs.append(ref)
            self.known[name] = at
        return at

    def _arrange(self) -> None:
        """Columns of all places: their rank in the sheets' order, sheet, row, whether a formula is there, the starts of cell and row."""
        import numpy as np
        import pyarrow as pa

        if self.arranged == len(self.spots):
            return
        self.arranged = len(self.spots)
        spots = np.array(self.spots, np.int64).reshape(-1, 3)
        self.sheet, self.row = spots[:, 0], spots[:, 1]
        order = np.lexsort(spots.T[::-1])
        self.rank = np.empty(len(spots), np.int64)
        self.rank[order] = np.arange(len(spots))
        of = [self.sheets[i][2] for i in self.sheet.tolist()]
        self.fixed = np.array([ref in s.fixed for s, ref in zip(of, self.refs, strict=True)], bool)
        self.heads = pa.array([s.heads.get(ref) or f'<c r="{ref}"' for s, ref in zip(of, self.refs, strict=True)], pa.string())
        self.row_heads = pa.array(["</row>" + (s.rows.get(row) or f'<row r="{row}"') + ">" for s, row in zip(of, self.row.tolist(), strict=True)], pa.string())

    def filled(self, writes):
        """(project, content) of writes (project, name, num, text, force), whose rows of a project follow each other; of several writes to a cell the last one counts.

        A cell's name is "sheet!reference", since each column that is sent here costs time for each row.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.known) > _MOST_PLACES:
            self._forget()
        project = writes["project"].dictionary_encode("encode").indices.to_numpy()
        begins = np.flatnonzero(np.diff(project, prepend=-1))
        count, sheets = len(begins), len(self.sheets)
        of = np.repeat(np.arange(count), np.diff(begins, append=len(project)))
        names = writes["name"].dictionary_encode("encode")
        place = np.array([self._place(n) for n in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
        self._arrange()

        head = self.heads.take(pa.array(np.maximum(place, 0)))
        num, text = pc.if_else(pc.is_nan(writes["num"]), None, writes["num"]), pc.fill_null(writes["text"], "")
        for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = pc.replace_substring(text, sign, entity)
        as_num = pc.binary_join_element_wise(head, "><v>", num.cast(pa.string()), "</v></c>", "")
        xml = pc.coalesce(as_num, pc.binary_join_element_wise(head, ' t="inlineStr"><is><t>', text, "</t></is></c>", ""))

        # Each project has the template's cells, then its writes in their order; the last of a place stays, and a formula against a free write.
        own, there = len(self.own), np.flatnonzero(place >= 0)
        which = np.concatenate([np.tile(np.arange(own), count), own + there])
        to = np.concatenate([np.tile(np.arange(own), count), place[there]])
        of = np.concatenate([np.repeat(np.arange(count), own), of[there]])
        written = np.zeros(count * sheets, bool)
        written[of[own * count :] * sheets + self.sheet[place[there]]] = True
        rank = of * len(self.spots) + self.rank[to]
        order = np.argsort(rank, kind="stable")
        order = order[np.diff(rank[order], append=-1) != 0]
        which, to, on = which[order], to[order], (of * sheets + self.sheet[to])[order]
        force = np.concatenate([np.ones(own, bool), pc.fill_null(writes["force"], False).to_numpy(zero_copy_only=False)])
        which = np.where(self.fixed[to] & ~force[which], to, which)
        which, to, on = (x[written[on]] for x in (which, to, on))

        new_sheet = np.diff(on, prepend=-1) != 0
        new_row = new_sheet | (np.diff(self.row[to], prepend=-1) != 0)
        row_heads = self.row_heads.take(pa.array(to, mask=~new_row))
        cells = pc.binary_join_element_wise(pc.fill_null(row_heads, ""), pa.concat_arrays([self.own_xml, xml]).take(pa.array(which)), "")
        data, first = cells.buffers()[2], np.flatnonzero(new_sheet)
        ends = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset :][[*first, len(cells)]].tolist()
        bodies: list[dict] = [{} for _ in range(count)]
        for k, at in enumerate(on[first].tolist()):
            before, after = self.frames[at % sheets]
            bodies[at // sheets][self.sheets[at % sheets][0]] = b"".join((before, data[ends[k] + len("</row>") : ends[k + 1]], after))
        contents = pa.array([self.zipped(b) for b in bodies], pa.binary())
        return pa.RecordBatch.from_arrays([writes["project"].take(pa.array(begins)), contents], names=["project", "content"])

    def zipped(self, written: dict[str, bytes]) -> bytes:
        """The workbook with some parts written anew."""
        return _archive((part, _packed(written[part]) if part in written else self.packed[part]) for part, _ in self.parts)


@lru_cache(maxsize=4)
def _filler(template: bytes) -> _Filler:
    """A template's filler, one for all workbooks of a worker."""
    return _Filler(template)


def _packed(data: bytes) -> tuple[int, int, bytes]:
    """Check sum, size and compressed bytes of an archive's part."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -zlib.MAX_WBITS)
    return zlib.crc32(data), len(data), packer.compress(data) + packer.flush()


def _archive(parts: Iterable[tuple[str, tuple[int, int, bytes]]]) -> bytes:
    """A ZIP archive of packed parts, most of which are the same in many archives and so are packed once."""
    out, index, offset = [], [], 0
    for part, (check, size, packed) in parts:
        name = part.encode()
        about = struct.pack("<5H3L2H", 20, 0x800, zipfile.ZIP_DEFLATED, 0, 0x21, check, len(packed), size, len(name), 0)
        out += (b"PK\x03\x04", about, name, packed)
        index += (b"PK\x01\x02\x14\x00", about, struct.pack("<3H2L", 0, 0, 0, 0, offset), name)
        offset += 4 + len(about) + len(name) + len(packed)
    count, size = len(index) // 4, sum(map(len, index))
    return b"".join((*out, *index, b"PK\x05\x06", struct.pack("<4H2LH", 0, 0, count, count, size, offset, 0)))


def _whole_projects(batches: Iterable) -> Iterator:
    """Record batches of whole projects, of batches in which the rows of a project follow each other."""
    import numpy as np
    import pyarrow as pa

    one = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    held: list = []  # of the last project
    for batch in batches:
        if not batch.num_rows:
            continue
        project = batch["project"].dictionary_encode("encode").indices.to_numpy()
        ends = np.flatnonzero(project != project[-1])
        cut = int(ends[-1]) + 1 if len(ends) else 0
        if held and (cut or held[0]["project"][0].as_py() != batch["project"][0].as_py()):
            yield one([*held, batch.slice(0, cut)] if cut else held)
            held = []
        elif cut:
            yield batch.slice(0, cut)
        held.append(batch.slice(cut))
    if held:
        yield one(held)


def write_workbooks(writes: DataFrame, template: bytes, together: bool = False) -> DataFrame:
    """(project, content): each project's filled template.

    ``together`` says that the writes of a project follow each other in one partition, in the order in which they are to be
    made, so they need not be dealt by project.
    """
    ship(writes.sparkSession)
    name = F.concat(F.coalesce("sheet", F.lit("")), F.lit("!"), F.col("ref")).alias("name")
    rows = writes.select(F.col("project").cast("string").alias("project"), name, F.col("num").cast("double").alias("num"), F.col("text").cast("string").alias("text"), "force")
    if not together:
        rows = rows.repartition("project").sortWithinPartitions("project")

    def run(batches):
        for whole in _whole_projects(batches):
            yield _filler(template).filled(whole)

    return rows.mapInArrow(run, "project string, content binary")
