"""Layout-aware text of HTML pages: a tree builder with implied tags drives the rendering of all visible text."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: A column is padded to this width at most; longer cells overhang, so that padding cannot outgrow the page.
COLUMN_WIDTH = 60
#: Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style title noscript noembed noframes template iframe object datalist audio video canvas".split())
#: What may stand in a head; any other start tag, or text, ends it.
HEAD = frozenset("base basefont bgsound html link meta noframes noscript script style template title".split())
#: Start tags that end svg and math, elements in these that hold HTML again, those that are never shown, and layouts of several cells.
OUTER = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
INNER = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext annotation-xml".split())}
UNSHOWN = frozenset("title desc metadata defs symbol clippath mask pattern marker style script annotation annotation-xml mphantom".split())
CELLS = frozenset("math:mfrac math:mroot math:mtable math:mtr".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset form hr".split())
BLOCK = APART | frozenset("address article aside body caption center dd details dialog dir div dt figcaption footer header hgroup html legend li main menu nav optgroup option search section summary tbody td tfoot th thead tr".split())
#: What an opening tag ends: the elements, and those beyond which it does not look.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
} | dict.fromkeys(("thead", "tbody", "tfoot", "caption"), ({"thead", "tbody", "tfoot", "caption"}, {"table"}))
ENDS |= dict.fromkeys(BLOCK - ENDS.keys() - {"html", "body"}, ({"p"}, {"td", "th", "table", "caption", "button", "li", "div"}))
#: An end tag of another element does not reach out of these.
WALLS = frozenset({"td", "th", "caption", "table"})

# A quote delimits a value only right after the equals sign; an attribute's name may hold quotes.
_NAME, _VALUE = r"[^\s/>][^\s/>=]*+", r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)"""
_ATTRIBUTE = re.compile(rf"({_NAME})(?:\s*+=\s*+({_VALUE})?+)?+")
# A comment ends at --> or --!>; right after its start > and -> end it too.
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAME}(?:\s*+=\s*+{_VALUE}?+)?+)*+)(>|\Z)", re.S)
_SPACES = re.compile(r"[ \t\n\r\f]+")
_DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)


def foreign(name: str) -> bool:
    """Whether an open element is svg or math, or of these; their elements are named with a prefix."""
    return ":" in name or name in ("svg", "math")


class Sheet:
    """Lines of text under construction: collapsed spaces, gaps between blocks, indents and list marks."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.indent, self.mark = 0, "", ""

    def begin(self) -> None:
        if self.lines and self.gap > 1:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0
        if self.mark:
            self.line.append(self.mark)
            self.mark = ""
        elif self.indent:
            self.line.append(self.indent)

    def end_line(self) -> None:
        self.lines.append("".join(self.line).rstrip(" "))
        self.line = []

    def apart(self, gap: int) -> None:
        """The next text starts a line, after ``gap`` - 1 empty ones."""
        if self.line:
            self.end_line()
        self.gap = max(self.gap, gap)

    def text(self, text: str) -> None:
        text = _SPACES.sub(" ", text)
        if not self.line or self.line[-1].endswith(" "):
            text = text.removeprefix(" ")
        if text:
            if not self.line:
                self.begin()
            self.line.append(text)

    def kept(self, text: str) -> None:
        """Preformatted text."""
        for i, part in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                if not self.line:
                    self.begin()
                self.lines.append("".join(self.line))
                self.line = []
            if part:
                if not self.line:
                    self.begin()
                self.line.append(part)

    def rows(self, lines: list[str]) -> None:
        for line in lines:
            self.apart(1)
            self.begin()
            self.line.append(line)
        self.apart(2)

    def done(self) -> list[str]:
        if self.line:
            self.end_line()
        return self.lines


class Grid:
    """Rows of cells, each a list of lines; laid out in aligned columns. A cell of several rows leaves its columns empty in the later ones."""

    def __init__(self):
        self.rows: list[list[list[str]]] = []
        self.taken: dict[int, int] = {}  # of columns, how many rows to come a cell above still takes
        self.covered: set[int] = set()

    def start_row(self) -> None:
        self.rows.append([])
        self.covered, self.taken = set(self.taken), {at: n - 1 for at, n in self.taken.items() if n > 1}

    def start_cell(self, columns: int, rows: int) -> None:
        row = self.rows[-1]
        while len(row) in self.covered:
            row.append([])
        if rows > 1:
            self.taken |= dict.fromkeys(range(len(row), len(row) + columns), rows - 1)
        row += [[]] * columns

    def end_group(self) -> None:
        self.taken = {}

    def lines(self) -> list[str]:
        widths: list[int] = []
        for row in self.rows:
            widths += [0] * (len(row) - len(widths))
            for i, cell in enumerate(row):
                widths[i] = max([widths[i], *(min(len(x), COLUMN_WIDTH) for x in cell)])
        # Columns that no row fills are left out, so that a cell over very many columns costs no text
        filled = [i for i, w in enumerate(widths) if w]
        return [" | ".join((row[i][k] if k < len(row[i]) else "").ljust(widths[i]) for i in filled if i < len(row)).rstrip() for row in self.rows for k in range(max([1, *map(len, row)]))]


class Page:
    """Open elements of one page, and what they have put on the sheet."""

    def __init__(self):
        #: Tag, whether it is shown, whether its own text is visible, the indent outside it.
        self.open: list[tuple[str, bool, bool, str]] = []
        self.sheets, self.grids, self.counters = [Sheet()], [], []
        #: What the content of each open element is: "" for HTML, else "svg", "text" (of svg) or "math".
        self.kinds: list[str] = []
        #: Where in ``open`` each name stands, and each element that ends a search: those of svg and math that hold HTML, and all of HTML.
        self.places: dict[str, list[int]] = defaultdict(list)
        self.holders: list[int] = []
        self.plain: list[int] = []
        self.pre, self.headed = 0, False

    @property
    def kind(self) -> str:
        return self.kinds[-1] if self.kinds else ""

    @property
    def shown(self) -> bool:
        return not self.open or self.open[-1][1]

    @property
    def visible(self) -> bool:
        return not self.open or self.open[-1][2]

    def looks(self, told: dict[str, str], unshown: bool) -> tuple[bool, bool]:
        """Whether an element is shown, which all around it must be, and visible, which it may be in what is not."""
        style = {name.lower(): value.lower() for name, value in _DECLARATION.findall(told.get("style", ""))}
        shown = self.shown and not unshown and "hidden" not in told and style.get("display") != "none"
        wanted = style.get("visibility", "inherit")
        return shown, self.visible if wanted in ("inherit", "unset") else wanted not in ("hidden", "collapse")

    def push(self, name: str, seen: bool, visible: bool, kind: str) -> None:
        at = len(self.open)
        self.open.append((name, seen, visible, self.sheets[-1].indent))
        self.kinds.append(kind)
        self.places[name].append(at)
        if not kind and ":" in name:
            self.holders.append(at)
        if not foreign(name):
            self.plain.append(at)

    def last(self, tag: str) -> int:
        """Where the last open element of a name stands, -1 without one."""
        held = self.places.get(tag)
        return held[-1] if held else -1

    def has(self, tag: str) -> bool:
        return self.last(tag) >= 0

    def close(self, at: int) -> None:
        while len(self.open) > at:
            self.end_last()

    def end_to(self, tags, walls) -> bool:
        """Ends the last open element of some names, unless a wall stands above it; no walk over what is open."""
        at = max(map(self.last, tags))
        if at < 0 or at < max([*map(self.last, walls), *self.holders[-1:]], default=-1):
            return False
        self.close(at)
        return True

    def end_head(self) -> None:
        """What is no part of a head ends the one that is open."""
        self.headed = True
        if self.open and self.open[-1][0] == "head":
            self.end_last()

    def start_foreign(self, tag: str, attributes: str) -> None:
        """An element of svg or math, or such an element itself; "/>" ends it."""
        root = "math" if "math" in (tag, self.kind) and tag != "svg" else "svg"
        told = attributes_of(attributes)
        told["style"] = ";".join([f"{name}:{told[name]}" for name in ("display", "visibility") if name in told] + [told.get("style", "")])
        seen, visible = self.looks(told, bool(self.kind) and tag in UNSHOWN)
        sheet = self.sheets[-1]
        if seen and self.open and self.open[-1][0] in CELLS:
            sheet.text(" ")
        if seen and self.kind == "svg" and tag == "text":
            sheet.apart(1)
        if ends_itself(attributes):
            return
        if tag in ("svg", "math"):
            name, kind = tag, tag
        elif tag in INNER[root]:
            name, kind = f"{root}:{tag}", ""
        else:
            name, kind = f"{root}:{tag}", "text" if root == "svg" and tag == "text" else self.kind
        self.push(name, seen, visible, kind)

    def start(self, tag: str, attributes: str) -> None:
        if tag == "head" and self.headed:
            return
        if tag not in HEAD and tag != "head":
            self.end_head()
        self.headed = self.headed or tag != "html"
        if self.kind and (tag in OUTER or tag == "font" and {"color", "face", "size"} & attributes_of(attributes).keys()):
            while self.kind:
                self.end_last()
        if self.kind or tag in ("svg", "math"):
            self.start_foreign(tag, attributes)
            return
        if tag in ENDS:
            while self.end_to(*ENDS[tag]) and tag in ("tr", "thead", "tbody", "tfoot"):
                pass
        if tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") and not self.has("table"):
            return
        if tag in ("td", "th") and self.last("tr") < self.last("table"):
            self.start("tr", "")
        told = attributes_of(attributes) if attributes.strip(" /\n\t\r\f") else {}
        seen, visible = self.looks(told, tag in UNSEEN or tag == "dialog" and "open" not in told)
        sheet = self.sheets[-1]
        if seen:
            if tag == "br":
                if not sheet.line:
                    sheet.begin()
                sheet.end_line()
            elif tag == "hr" and visible:
                sheet.rows(["---"])
            elif tag in BLOCK:
                sheet.apart(2 if tag in APART and not (tag in ("ul", "ol") and self.counters) else 1)
        if tag in VOID:
            return
        self.push(tag.replace(":", "-"), seen, visible, "")
        if tag in ("ul", "ol", "menu", "dir"):
            start = told.get("start", "")
            self.counters.append((int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1) if tag == "ol" else None)
        elif tag == "li" and seen:
            number = self.counters[-1] if self.counters else None
            if number is not None and re.fullmatch(r"-?[0-9]{1,9}", told.get("value", "")):
                number = self.counters[-1] = int(told["value"])
            mark = "- " if number is None else f"{number}. "
            if number is not None:
                self.counters[-1] += 1
            sheet.mark = (sheet.mark or sheet.indent) + mark
            sheet.indent += " " * len(mark)
        elif tag in ("blockquote", "dd") and seen:
            sheet.indent += "  "
        elif tag == "pre":
            self.pre += 1
        elif tag == "table":
            self.grids.append(Grid())
        elif tag == "tr":
            self.grids[-1].start_row()
        elif tag in ("td", "th"):
            self.sheets.append(Sheet())
            # The most columns and rows of a cell; 0 rows are all that are left of the group
            self.grids[-1].start_cell(min(number_of(told.get("colspan")) or 1, 1000), min(number_of(told.get("rowspan"), 1) or 65534, 65534))

    def end_last(self) -> None:
        tag, seen, _, indent = self.open.pop()
        self.kinds.pop()
        self.places[tag].pop()
        for held in (self.holders, self.plain):
            if held and held[-1] == len(self.open):
                held.pop()
        if tag in ("td", "th"):
            row, cell = self.grids[-1].rows[-1], self.sheets.pop().done()
            first = len(row) - 1
            while first and row[first - 1] is row[first] and not row[first]:
                first -= 1
            row[first] = cell
            return
        sheet = self.sheets[-1]
        if tag == "table":
            grid = self.grids.pop()
            if seen:
                sheet.rows([x for x in grid.lines() if x])
        elif tag in ("thead", "tbody", "tfoot"):
            self.grids[-1].end_group()
        elif tag in ("ul", "ol", "menu", "dir"):
            self.counters.pop()
        elif tag == "pre":
            self.pre -= 1
        if seen and tag in BLOCK:
            sheet.apart(2 if tag in APART and not (tag in ("ul", "ol") and self.counters) else 1)
        if seen and tag == "svg:text":
            sheet.apart(1)
        if tag == "li":
            sheet.mark = ""
        sheet.indent = indent

    def end_foreign(self, tag: str) -> bool:
        """Ends the element of svg or math that is meant, if the innermost open element is of these."""
        at = max(self.last(f"svg:{tag}"), self.last(f"math:{tag}"), self.last(tag) if tag in ("svg", "math") else -1)
        if at < 0 or self.plain and self.plain[-1] > at:
            return False
        self.close(at)
        return True

    def end(self, tag: str) -> None:
        if self.end_foreign(tag):
            return
        tag = tag.replace(":", "-")
        if tag in ("html", "body"):
            self.end_head()
        if tag == "br":
            self.start("br", "")
        elif tag not in ("html", "body"):
            self.end_to({tag}, WALLS - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else {"table"} - {tag})

    def text(self, text: str, raw: bool = False) -> None:
        if not self.headed or self.open and self.open[-1][0] == "head":
            if _SPACES.sub("", text):
                self.end_head()
        if self.shown and self.visible and self.kind != "svg" and not (self.kind == "math" and not _SPACES.sub("", text)):
            text = html.unescape(text) if "&" in text and not raw else text
            if self.pre:
                self.sheets[-1].kept(text)
            else:
                self.sheets[-1].text(text)

    def done(self) -> str:
        while self.open:
            self.end_last()
        return "\n".join(self.sheets[0].done())


def attributes_of(text: str) -> dict[str, str]:
    """Attributes of a tag by name; of several of one name the first counts."""
    told: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        told.setdefault(name.lower(), html.unescape(value))
    return told


def ends_itself(attributes: str) -> bool:
    """Whether a tag ends in a slash that is no part of a value without quotes."""
    if not attributes.endswith("/"):
        return False
    last = None
    for last in _ATTRIBUTE.finditer(attributes):  # noqa: B007
        pass
    return last is None or last.end() < len(attributes)


def number_of(text: str | None, missing: int = 0) -> int:
    digits = re.match(r"\s*\+?([0-9]{1,9})", text or "")
    return int(digits[1]) if digits else missing


def visible_text(source: str) -> str:
    """All visible text of a page, laid out: empty lines around paragraphs, marked and indented lists, aligned cells."""
    page, at = Page(), 0
    while (token := _TOKEN.search(source, at)) is not None:
        if token.start() > at:
            page.text(source[at : token.start()])
        at = token.end()
        if page.open and foreign(page.open[-1][0]) and source.startswith("<![CDATA[", token.start()):
            end = source.find("]]>", token.start())
            page.text(source[token.start() + 9 : end if end >= 0 else len(source)], raw=True)
            at = end + 3 if end >= 0 else len(source)
            continue
        tag = (token[2] or "").lower()
        if not tag or not token[4]:
            continue  # a tag that the page's end cuts is no tag
        if token[1]:
            page.end(tag)
            continue
        page.start(tag, token[3])
        if tag in RAW and page.open and page.open[-1][0] == tag:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            if tag in ("textarea", "xmp"):
                page.text(source[at : end.start() if end else len(source)])
            page.end(tag)
            at = end.end() if end else len(source)
    if at < len(source):
        page.text(source[at:])
    return page.done()


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [visible_text(s or "") for s in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["page_id", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id and text of each row of ``pages`` (page_id, html).

    A null page is the empty page and gives empty text; a null id and repeated rows are kept; no rows give no rows; other
    columns are ignored, also those named text. Elements that are never closed end with the page; a comment that is never
    closed hides the rest, and a tag that the page's end cuts is left out. A page of any length is read whole.
    """
    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(_rendered, "page_id long, text string")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))
