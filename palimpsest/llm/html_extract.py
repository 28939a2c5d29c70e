"""HTML extraction with wrappers that are inferred per host.

A page is a stream of tokens: block tags and texts. The streams of all pages of
a host are aligned one after the other into the host's wrapper, a regular
expression without unions over elements and texts. Two sibling lists are walked
together; elements of one step go on inside. A text that differs becomes a slot.
A mismatch is resolved into a repeated group where one side runs on with another
round of what stands just before, or else into an optional group, by skipping to
the nearest place where both sides agree again. Each text of the wrapper knows
whether it was seen, unchanged, in different pages (then it belongs to the
template), and how many words stand there.

The wrapper says which of its places hold the article. Those are the places
inside the outermost <article> or <main>, or else inside the deepest element
with most of the words that change from page to page; not those inside of menus,
headers, footers, sidebars, notices, adverts, forms and comments, and not those
inside of a box whose texts never change. Paragraphs and headings that stay the
same among others that change are part of the article.

Then every page is matched against its host's wrapper and the texts at places
that hold the article are its result. A text without a place in the wrapper is
judged like the element around it. A host of one page (copies count once) has
the wrapper of that page.

All pages of a host take part: each partition folds its pages into one wrapper
for each host, and those are aligned in two rounds, so a host with most of the
pages meets in no task. Wrappers grow with the templates of a host, not with its
pages. They are sent to the executors if all of them together take at most
``most_sent`` bytes, and are joined by host otherwise.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._common import binary_text, materialize, slices_by_bytes, utf8

# Element names of HTML and words in class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math head title textarea select canvas audio video map".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img nobr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr caption figcaption address".split())
NOISE = frozenset("nav header footer aside form menu button dialog fieldset datalist search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert note".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside widget related recommended masthead cookie cookies consent gdpr header footer "
    "notice popup modal overlay newsletter subscribe signup login share sharing social comment comments disqus replies "
    "reply respond discussion toolbar pagination pager copyright legal".split()
)
#: words that may stand beside a noise word in a class; with any other word the class says something else
NEUTRAL = frozenset(
    "top bottom left right main site page global primary secondary inner outer box list section area block container "
    "wrapper wrap bar links link buttons button icons item items thread group row col content body text title form area "
    "posts post articles article stories story module panel slot unit js the my".split()
)
LEAF_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsored promo cookie cookies newsletter comment comments".split())
COMMENT_WORDS = frozenset("comment comments disqus replies reply".split())
MAIN = ("article", "main")
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# a quote counts only where a value begins
LEX = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S,
)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))""", re.I)
DIGITS = re.compile(r"\d+")
Token = tuple[str, str]  # "+" open, "-" close or "t" text; step or text


def noisy_class(mark: str, words: frozenset[str]) -> bool:
    """Whether a class or id is made of noise words, and of others that change nothing, only."""
    own = {w for w in re.split(r"[^a-z]+", mark) if w}
    return bool(own & words) and own <= words | NOISE_WORDS | NEUTRAL


def step_of(name: str, attrs: str) -> str:
    """An element as a step: its name, its role, its classes and an id that names noise, without their numbers."""
    marks = set()
    if name not in ("html", "body"):
        for key, *values in ATTR.findall(attrs) if "=" in attrs else ():
            value = DIGITS.sub("", next((v for v in values if v), "").lower())
            if key.lower() == "role":
                marks.update(f"@{v}" for v in value.split())
            elif key.lower() == "class":
                marks.update(f".{v}" for v in value.split())
            else:
                marks.update(f".{v}" for v in value.split() if noisy_class(v, NOISE_WORDS))
    return name + "".join(sorted(marks))


def parts_of(step: str) -> tuple[str, list[str]]:
    name = re.split(r"[.@]", step, maxsplit=1)[0]
    return name, re.findall(r"[.@][^.@]+", step[len(name) :])


def is_noise(step: str) -> bool:
    """Whether an element is a menu, header, footer, sidebar, notice, advert, form or comments by its name or marks."""
    name, marks = parts_of(step)
    if name in NOISE:
        return True
    if name in ("html", "body"):
        return False
    words = COMMENT_WORDS if name in MAIN else LEAF_WORDS if name in LEAF else NOISE_WORDS
    return any(m[1:] in NOISE_ROLES if m[0] == "@" else noisy_class(m[1:], words) for m in marks)


def tokens(page: str) -> list[Token]:
    """Block tags, with what HTML leaves out put in, and texts; inline tags, markup and hidden elements are left out."""
    out: list[Token] = []
    stack: list[str] = []  # steps of open blocks
    names: list[str] = []
    text: list[str] = []
    skip_to = 0

    def flush() -> None:
        value = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if value:
            out.append(("t", value))

    def close(k: int) -> None:
        while len(stack) > k:
            names.pop()
            out.append(("-", stack.pop()))

    for m in LEX.finditer(page):
        if m.start() < skip_to:
            continue
        if m["text"] is not None:
            text.append(m["text"])
            continue
        if m["cdata"] is not None:
            text.append(html.escape(m["cdata"], quote=False))
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            if name == "p" and "p" not in names:
                flush()
            elif name not in INLINE and name in names:
                flush()
                close(len(names) - 1 - names[::-1].index(name))
            continue
        if name in RAW:
            if not m["attrs"].rstrip().endswith("/"):
                end = re.compile(f"</{name}\\s*>", re.I).search(page, m.end())
                if end:
                    skip_to = end.end()
                elif name in ("script", "style"):
                    skip_to = len(page)
                elif name != "head":  # never closed: only its own text goes
                    skip_to = page.find("<", m.end()) % (len(page) + 1)
            text.append(" " if name not in ("head", "title") else "")
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in INLINE:
            continue
        flush()
        if name in VOID:
            continue
        if name in CLOSES_P and "p" in names:
            close(len(names) - 1 - names[::-1].index("p"))
        for other in SELF_CLOSING.get(name, ()):
            stop = max((k for k, x in enumerate(names) if x in ("ul", "ol", "dl", "table", "select")), default=-1)
            if other in names[stop + 1 :]:
                close(len(names) - 1 - names[::-1].index(other))
        step = step_of(name, m["attrs"] or "")
        stack.append(step)
        names.append(name)
        out.append(("+", step))
    flush()
    close(0)
    return out


# A wrapper is a list of items [quantity, units]: once (""), optional ("?") or repeated ("*"). A unit is
# an element [step, items] or a text [value or None for a slot, page, shared, words]: ``page`` is that where the value was
# seen first, ``shared`` says that it was seen in different pages. A page is a wrapper whose items are single units.
ELEMENT, STRONGER = 2, {("", ""): "", ("?", ""): "?", ("", "?"): "?", ("?", "?"): "?"}


def digest(text: str) -> str:
    """A text as a wrapper holds it: itself, or what stands for a long one."""
    return text if len(text) <= 40 else f"{zlib.crc32(text.encode('utf-8', 'replace'))}:{len(text)}:{text[:16]}"


def as_items(stream: list, page: int) -> list:
    """Items of a flat stream, which may have slots and groups."""
    levels: list[list] = [[]]
    for kind, *value in stream:
        if kind == "+":
            unit = [value[0], []]
            levels[-1].append(["", [unit]])
            levels.append(unit[1])
        elif kind == "-":
            levels.pop()
        elif kind in "?*":
            levels[-1].append([kind, [u for _, units in as_items(value[0], page) for u in units]])
        else:
            text = value[0] if kind == "t" else None
            levels[-1].append(["", [[None if text is None else digest(text), page, False, len((text or "").split())]]])
    return levels[0]


def as_stream(items: list) -> list:
    """The flat form of items: tags, texts, slots ("s", ""), and groups ("?" or "*", part)."""
    out: list = []
    for quantity, units in items:
        part: list = []
        for u in units:
            if len(u) == ELEMENT:
                part += [("+", u[0]), *as_stream(u[1]), ("-", u[0])]
            else:
                part.append(("s", "") if u[0] is None else ("t", u[0]))
        out += [(quantity, part)] if quantity else part
    return out


def key(unit: list) -> str:
    return unit[0] if len(unit) == ELEMENT else ""


def keys(item: list) -> list[str]:
    return [u[0] if len(u) == ELEMENT else "" for u in item[1]]


def fold_unit(a: list, b: list) -> None:
    """Generalise unit ``a`` of a wrapper so that it also gives ``b``."""
    if len(a) == ELEMENT:
        a[1] = fold(a[1], b[1])
        return
    if a[0] is not None and a[0] == b[0]:
        a[2] = a[2] or b[2] or a[1] != b[1]
    else:
        a[0], a[2] = None, False
    a[3] += b[3]


def fold_item(a: list, b: list) -> list:
    for u, v in zip(a[1], b[1], strict=True):
        fold_unit(u, v)
    a[0] = STRONGER.get((a[0], b[0]), "*")
    return a


class Places:
    """Where the items of a sibling list begin with a key."""

    def __init__(self, items: list):
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        for i, item in enumerate(items):
            self.at[key(item[1][0])].append(i)

    def after(self, wanted: str, i: int) -> int:
        """The first place behind ``i``, or a huge number."""
        found = self.at.get(wanted, ())
        k = bisect_right(found, i)
        return found[k] if k < len(found) else 1 << 60


def common_step(a: str, b: str) -> str:
    """The step of what two elements of one name share, or an empty string."""
    (name, marks), (other, more) = parts_of(a), parts_of(b)
    own = sorted(set(marks) & set(more))
    return name + "".join(own) if name == other and own else ""


def steps(a: list, b: list) -> Iterator[tuple[str, int, int, int]]:
    """How two sibling lists go together: (what, place in a, place in b, number of items).

    "=" both items agree; "<" the group in a takes so many items of b; ">" the
    group in b takes so many of a; "~" both are elements of one name with marks in common; "a" and "b": items of
    one side only.
    """
    i = j = 0
    ahead: tuple[Places, Places] | None = None
    while i < len(a) and j < len(b):
        x, y = a[i], b[j]
        kx, ky = keys(x), keys(y)
        if kx == ky:
            yield "=", i, j, 1
            i, j = i + 1, j + 1
            if x[0] == "*" or y[0] == "*":  # further rounds
                n = len(kx)
                while j + n <= len(b) and [key(z[1][0]) for z in b[j : j + n] if len(z[1]) == 1 and z[0] != "*"] == kx:
                    yield "<", i - 1, j, n
                    j += n
                while i + n <= len(a) and [key(z[1][0]) for z in a[i : i + n] if len(z[1]) == 1 and z[0] != "*"] == kx:
                    yield ">", i, j - 1, n
                    i += n
            continue
        n = len(kx)
        if x[0] and n > 1 and [key(z[1][0]) for z in b[j : j + n] if len(z[1]) == 1] == kx:
            yield "<", i, j, n
            j += n
            while x[0] == "*" and [key(z[1][0]) for z in b[j : j + n] if len(z[1]) == 1] == kx:
                yield "<", i, j, n
                j += n
            i += 1
            continue
        n = len(ky)
        if y[0] and n > 1 and [key(z[1][0]) for z in a[i : i + n] if len(z[1]) == 1] == ky:
            yield ">", i, j, n
            i, j = i + n, j + 1
            continue
        # one side goes on with another round of what both had last
        round_b = again(a, b, i, j)
        if round_b:
            yield "r", i, j, round_b
            j += round_b
            continue
        round_a = again(b, a, j, i)
        if round_a:
            yield "R", i, j, round_a
            i += round_a
            continue
        if ahead is None:
            ahead = Places(a), Places(b)
        to_a, to_b = ahead[0].after(ky[0], i), ahead[1].after(kx[0], j)
        if min(to_a - i, to_b - j) > len(a) + len(b):
            if len(x[1]) == len(y[1]) == 1 and kx[0] and ky[0] and common_step(kx[0], ky[0]):
                yield "~", i, j, 1
            else:
                yield "a", i, j, 1
                yield "b", i, j, 1
            i, j = i + 1, j + 1
        elif to_a - i <= to_b - j:
            yield "a", i, j, to_a - i
            i = to_a
        else:
            yield "b", i, j, to_b - j
            j = to_b
    while j < len(b) and (n := again(a, b, i, j)):
        yield "r", i, j, n
        j += n
    while i < len(a) and (n := again(b, a, j, i)):
        yield "R", i, j, n
        i += n
    if i < len(a):
        yield "a", i, j, len(a) - i
    if j < len(b):
        yield "b", i, j, len(b) - j


def again(a: list, b: list, i: int, j: int) -> int:
    """How many items of ``b`` from ``j`` on are a further round of the items just before ``j`` (and before ``i`` in ``a``), or 0."""
    wanted = key(b[j][1][0])
    if not wanted or b[j][0] or len(b[j][1]) != 1:
        return 0
    for n in range(1, min(i, j, 4) + 1):
        if key(b[j - n][1][0]) == wanted:
            own = [keys(z) for z in b[j : j + n]]
            whole = len(own) == n and own == [keys(z) for z in b[j - n : j]] == [keys(z) for z in a[i - n : i]]
            plain = all(not z[0] for z in b[j : j + n]) and (n == 1 or all(not z[0] for z in a[i - n : i]))
            return n if whole and plain else 0
    return 0


def optional(items: list) -> list:
    """Items that one side lacks: one group of those that stand there once, groups as they are."""
    out: list = []
    for quantity, units in items:
        if quantity:
            out.append([quantity, units])
        elif out and out[-1][0] == "!":
            out[-1][1] += units
        else:
            out.append(["!", list(units)])
    return [["?" if q == "!" else q, u] for q, u in out]


def fold(a: list, b: list) -> list:
    """Generalise the items ``a`` of a wrapper so that they also give ``b``; ``a`` is used up."""
    out: list = []
    for what, i, j, n in steps(a, b):
        if what == "=":
            out.append(fold_item(a[i], b[j]))
        elif what == "~":
            a[i][1][0][0] = common_step(a[i][1][0][0], b[j][1][0][0])
            fold_unit(a[i][1][0], b[j][1][0])
            a[i][0] = STRONGER.get((a[i][0], b[j][0]), "*")
            out.append(a[i])
        elif what in "<r":
            if what == "<" and out[-1:] != [a[i]]:
                out.append(a[i])
            if what == "r":
                _gather(out, n)
            for u, z in zip(out[-1][1], b[j : j + n], strict=True):
                fold_unit(u, z[1][0])
        elif what in ">R":
            if what == "R":
                _gather(out, n)
            elif not out or keys(out[-1]) != keys(b[j]):
                out.append(b[j])
            for u, z in zip(out[-1][1], a[i : i + n], strict=True):
                fold_unit(u, z[1][0])
        else:
            out += optional(a[i : i + n] if what == "a" else b[j : j + n])
    return out


def _gather(out: list, n: int) -> None:
    """Make the last ``n`` items one repeated group."""
    if n == 1:
        out[-1][0] = "*"
    else:
        out[-n:] = [["*", [z[1][0] for z in out[-n:]]]]


def align(wrapper: list, stream: list[Token]) -> list:
    """Generalise a wrapper, in its flat form, so that it also gives the stream."""
    return as_stream(fold(as_items(wrapper, 1), as_items(stream, 2)))


# What a wrapper says: for each unit, by its identity, whether it holds the article.


def drops(step: str, items: list, inside: bool) -> bool:
    """Whether an element is no part of an article; ``inside`` of one, a header with a heading is."""
    if not is_noise(step):
        return False
    name = parts_of(step)[0]
    if name == "header" and inside:
        return not any(parts_of(u[0])[0] in HEADINGS for u in elements(items))
    if name == "form":  # one around the whole page is none
        return not any(parts_of(u[0])[0] in MAIN for u in elements(items))
    return True


def elements(items: list) -> Iterator[list]:
    for _, units in items:
        for u in units:
            if len(u) == ELEMENT:
                yield u
                yield from elements(u[1])


def words_in(items: list, changing: bool, inside: bool = False) -> int:
    """Words of texts outside of noise; if ``changing``, of those that are not the template's."""
    total = 0
    for _, units in items:
        for u in units:
            if len(u) == ELEMENT:
                if not drops(u[0], u[1], inside):
                    total += words_in(u[1], changing, inside or parts_of(u[0])[0] in MAIN)
            elif not (changing and u[2]):
                total += u[3]
    return total


def roots_of(items: list) -> list[list]:
    """The outermost <article> and <main> elements outside of noise."""
    found: list[list] = []
    for _, units in items:
        for u in units:
            if len(u) == ELEMENT and not drops(u[0], u[1], False):
                name, marks = parts_of(u[0])
                found += [u] if name in MAIN or "@main" in marks else roots_of(u[1])
    return found


def heart(items: list, changing: bool) -> list:
    """The deepest element with most of the words, as a unit; one around ``items`` if there is none."""
    here = ["", items]
    total = words_in(items, changing)
    while True:
        best, much, many = None, 0, ""
        for quantity, units in here[1]:
            for u in units:
                if len(u) == ELEMENT and not drops(u[0], u[1], False) and (n := words_in(u[1], changing)) > much:
                    best, much, many = u, n, quantity
        if best is None or much < 0.6 * total or many == "*" or parts_of(best[0])[0] in (*LEAF, "ul", "ol", "dl", "table", "tbody"):
            return here
        here = best


def mark(items: list, held: set[int]) -> None:
    """Note the units that hold the article: all but noise, and boxes that never change."""
    for _, units in items:
        for u in units:
            if len(u) == ELEMENT:
                box = parts_of(u[0])[0] not in LEAF
                if not drops(u[0], u[1], True) and not (box and words_in(u[1], False, True) and not words_in(u[1], True, True)):
                    held.add(id(u))
                    mark(u[1], held)
            else:
                held.add(id(u))


class Wrapper:
    """A host's expression and its places that hold the article."""

    def __init__(self, items: list):
        self.items = items
        changing = any(u[0] is None for u in texts_of(items))  # else it is one page, and nothing is known to be the template's
        if not changing:
            for u in texts_of(items):
                u[2] = False
        roots = [r for r in roots_of(items) if words_in(r[1], False, True)]
        self.roots = roots or [heart(items, True)]
        self.held: list[set[int]] = []
        for r in self.roots:
            own: set[int] = {id(r)}
            mark(r[1], own)
            self.held.append(own)
        self.constants = sorted(u[0] for u in texts_of(items) if u[2])

    def article(self, stream: list[Token]) -> list[str]:
        """The texts of a page at places that hold the article."""
        best: list[str] = []
        most = -1
        page = as_items(stream, 0)
        values = iter([v for kind, v in stream if kind == "t"])
        label(page, values)
        for r, held in zip(self.roots, self.held, strict=True):
            out: list[str] = []
            emit(self.items, page, held, not r[0], out)  # without an element that holds it, the page does
            if (n := sum(len(x.split()) for x in out)) > most:
                best, most = out, n
        return best


def texts_of(items: list) -> Iterator[list]:
    for _, units in items:
        for u in units:
            if len(u) == ELEMENT:
                yield from texts_of(u[1])
            else:
                yield u


def label(items: list, values: Iterator[str]) -> None:
    """Give the texts of a page's items their full values."""
    for u in texts_of(items):
        u[1] = next(values)


def emit(wrapper: list, page: list, held: set[int], inside: bool, out: list[str]) -> None:
    """Match the items of a page against those of its wrapper and put out the texts that the article holds."""

    def put(u: list | None, v: list) -> None:
        if len(v) != ELEMENT:
            if inside if u is None else id(u) in held:
                out.append(v[1])
        elif u is None:  # not in the wrapper
            if not drops(v[0], v[1], inside):
                emit([], v[1], held, inside, out)
        else:
            # inside an element that the article does not hold nothing is held
            emit(u[1], v[1], held, id(u) in held, out)

    last: list = []
    for what, i, j, n in steps(wrapper, page):
        if what in "=~":
            last = wrapper[i][1]
            put(last[0], page[j][1][0])
        elif what == "<":
            for u, z in zip(wrapper[i][1], page[j : j + n], strict=True):
                put(u, z[1][0])
            last = wrapper[i][1]
        elif what == "r":
            for k, z in enumerate(page[j : j + n]):
                put(wrapper[i - n + k][1][0] if i >= n else None, z[1][0])
        elif what == "b":
            for z in page[j : j + n]:
                put(None, z[1][0])


def read_wrapper(streams: list[list[Token]]) -> tuple[list, list[str]]:
    """The expression of some pages of a host, and the texts of its template."""
    streams = [s for k, s in enumerate(streams) if s not in streams[:k]]
    items = as_items(streams[0], 0)
    for number, stream in enumerate(streams[1:], 1):
        items = fold(items, as_items(stream, number))
    return items, Wrapper(items).constants


def extract(stream: list[Token], wrapper: Wrapper | tuple | None) -> str:
    """The article of one page by its host's wrapper, or else by the wrapper of the page alone."""
    if wrapper is None:
        wrapper = Wrapper(as_items(stream, 0))
    elif not isinstance(wrapper, Wrapper):
        wrapper = Wrapper([x for x in wrapper[0] if not isinstance(x, str)] or as_items(stream, 0))
    return "\n\n".join(wrapper.article(stream))


MOST_HELD = 1 << 20  # tokens of wrappers that a task holds before it hands them on
ROUNDS = (256, 1)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(_host, wrapper) for each host, over (_host, html); ``wrapper`` is JSON."""

    def fold_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def hand_on() -> pa.RecordBatch:
            rows = [pa.array(list(held), pa.string()), pa.array([json.dumps(x) for x in held.values()], pa.string())]
            return pa.RecordBatch.from_arrays(rows, names=["_host", "wrapper"])

        for whole in batches:
            for batch in slices_by_bytes(whole, "html", 1 << 22):
                for host, raw in zip(batch.column("_host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                    stream = tokens(utf8(raw))
                    if not stream:
                        continue
                    own = as_items(stream, zlib.crc32(raw))
                    if host in held:
                        held[host] = fold(held[host], own)
                    else:
                        held[host] = own
                        size += len(stream)
                    if size > MOST_HELD:
                        yield hand_on()
                        held.clear()
                        size = 0
        if held:
            yield hand_on()

    def merge(group: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.column("wrapper").to_pylist())  # the same order, whoever comes first
        items = json.loads(rows[0])
        for other in rows[1:]:
            items = fold(items, json.loads(other))
        return pa.table([pa.array([group[0].as_py()], pa.string()), pa.array([json.dumps(items)], pa.string())], names=["_host", "wrapper"])

    found = pages.select("_host", "html").mapInArrow(fold_pages, "_host string, wrapper string")
    for parts in ROUNDS:
        part = F.pmod(F.xxhash64("wrapper"), F.lit(parts)).alias("_part")
        found = found.groupBy("_host", part).applyInArrow(merge, "_host string, wrapper string")
    return found


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_sent: int = 32 << 20
) -> DataFrame:
    """Return id, url, the article's ``text`` and ``n_chars`` for every row.

    A null page is empty and has an empty text; a null or odd url counts as a
    page of the host without a name; truncated pages and unclosed elements end with the page;
    repeated rows give repeated rows; an empty table gives an empty result.
    Other columns are not read.
    """
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    own = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host.alias("_host"), binary_text(F.col(html_col)).alias("html"))
    wrappers = materialize(infer_wrappers(own.where("_host <> ''")))
    held = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("_host")).alias("n")).first()["n"] or 0
    sent = {r["_host"]: r["wrapper"] for r in wrappers.collect()} if held <= most_sent else None
    source = own if sent is not None else own.join(wrappers, "_host", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for whole in batches:
            for batch in slices_by_bytes(whole, "html", 1 << 22):
                found = []
                hosts = batch.column("_host").to_pylist()
                texts = batch.column("wrapper").to_pylist() if sent is None else map(sent.get, hosts)
                for host, text, raw in zip(hosts, texts, batch.column("html").to_pylist(), strict=True):
                    if text is not None and host not in known:
                        if len(known) >= 256:
                            known.clear()
                        known[host] = Wrapper(json.loads(text))
                    stream = tokens(utf8(raw))
                    found.append(extract(stream, None if text is None else known[host]) if stream else "")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), batch.column("_url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                    names=[id_col, url_col, "text", "n_chars"],
                )

    return source.mapInArrow(work, f"`{id_col}` {id_type}, `{url_col}` {url_type}, text string, n_chars long")
