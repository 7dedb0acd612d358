"""Words of whole pages in Arrow batches: rows of words, their line items, totals and customers.

A page is a row (bill_id, words), its words an array of structs; see spatial.as_pages.
A page is never split, so a task holds a batch of pages, and nothing is sorted or
grouped beyond it.  The functions here take a batch and give back columns.
"""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillmill.functions.numbers import MISREAD, SPACE
from quillmill.functions.text import NET_TOTAL, TOTAL, spelt

ANY_SPACE = r"[\s\v]"  # \s of Java; that of Arrow's patterns lacks one
_NUMBER = rf"^{ANY_SPACE}*(?P<n>[+\-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+\-]?[0-9]+)?)"
LABEL = r"(?i)^No\.?\z|^T0\z"
#: A registration number, of 13 to 17 characters.
SHAPE = spelt("[0-9][0-9][A-Z]" + "[A-Z0-9]" * 10 + "[A-Z0-9]?" * 4, exact=True)
ZONES = ("bill_no", "customer", "totals", "table")
#: Pages that are worked on at once.
PIECE = 1000


def _plain(mask: pa.Array) -> np.ndarray:
    return mask.to_numpy(zero_copy_only=False)


def _has(text: pa.Array, pattern: str, may: np.ndarray | None = None) -> np.ndarray:
    """Texts that fulfil the pattern; it is matched only where it ``may`` be."""
    if may is not None:
        out = may.copy()
        out[may] = _has(text.filter(pa.array(may)), pattern)
        return out
    return _plain(pc.match_substring_regex(text, re.sub(r"(?<!\[)\\s", lambda m: ANY_SPACE, pattern)))


def _begins(text: pa.Array, letter: str) -> np.ndarray:
    """Texts that begin with the letter, in either case."""
    return _plain(pc.or_(pc.starts_with(text, letter), pc.starts_with(text, letter.lower())))


class Page:
    """Normalized words of the pages of a batch, as columns; ``bill`` is each word's page, ``off`` where pages begin."""

    def __init__(self, ids: pa.Array, words: pa.ListArray):
        off = words.offsets.to_numpy()
        flat = words.flatten()
        of = dict(zip([f.name for f in flat.type], flat.flatten()))
        number = lambda c: pc.fill_null(of[c].cast(pa.float64()), 0.0).to_numpy()
        self.ids, self.n = ids, len(ids)
        self.off = off - off[0]
        self.bill = np.repeat(np.arange(self.n), np.diff(self.off))
        self.text = pc.utf8_trim(pc.fill_null(of["text"], ""), characters=SPACE)
        self.x0, self.y0, self.x1, self.y1 = (number(c) for c in ("x0", "y0", "x1", "y1"))
        self.ix = of["word_ix"].to_numpy(zero_copy_only=False)
        self.mid_x, self.mid_y = (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2

    @cached_property
    def height(self) -> np.ndarray:
        """The mean height of each page's words."""
        high = self.y1 > self.y0
        n = np.bincount(self.bill, high, self.n)
        total = np.bincount(self.bill, np.where(high, self.y1 - self.y0, 0.0), self.n)
        return np.where(n > 0, total / np.maximum(n, 1), 15.0)

    def tolerance(self, least: float) -> np.ndarray:
        """0.8 of the mean height of each page's words, at least ``least``."""
        return np.maximum(least, np.floor(self.height * 0.8 + 0.5))

    def first(self, where: np.ndarray, last: bool = False) -> np.ndarray:
        """Of each page the first (or last) word that fulfils ``where``; -1 without."""
        out = np.full(self.n, -1)
        at = np.flatnonzero(where)
        at = at[np.lexsort((self.ix[at], self.bill[at]))]
        if not last:
            at = at[::-1]
        out[self.bill[at]] = at  # what is written last stays
        return out


def _of(values: np.ndarray, at: np.ndarray, without: float) -> np.ndarray:
    return np.where(at >= 0, values[at], without) if len(values) else np.full(len(at), without)


def _ordered(at: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """``at`` by its keys, the first one first; pages mostly are in order already."""
    before, after = np.zeros(max(len(at) - 1, 0), bool), np.zeros(max(len(at) - 1, 0), bool)
    for k in keys:
        k = k[at]
        after |= ~before & (k[:-1] > k[1:])
        before |= ~after & (k[:-1] < k[1:])
    return at[np.lexsort([k[at] for k in reversed(keys)])] if after.any() else at


class Rows:
    """Rows of the words ``keep``: a new one begins where the step from the word before exceeds the page's tolerance.

    ``at`` holds the words row by row, each from left to right; ``start`` where rows begin in it, and the end.
    """

    def __init__(self, p: Page, keep: np.ndarray, tolerance: np.ndarray, up: bool = False):
        y = -p.mid_y if up else p.mid_y
        at = _ordered(np.flatnonzero(keep), p.bill, y, *([] if up else [p.mid_x]), p.ix)
        begins = np.ones(len(at), bool)
        b, y = p.bill[at], p.mid_y[at]
        begins[1:] = (b[1:] != b[:-1]) | (np.abs(y[1:] - y[:-1]) > tolerance[b[1:]])
        row = np.zeros(len(p.bill), np.int64)
        row[at] = np.cumsum(begins) - 1
        self.at = _ordered(at, row, p.mid_x, p.mid_y, p.ix)
        self.row = row[self.at]
        self.start = np.append(np.flatnonzero(begins), len(at))
        self.size = np.diff(self.start)
        self.bill = b[begins]
        first = np.searchsorted(self.bill, np.arange(p.n))
        self.ix = np.arange(len(self.bill)) - first[self.bill]


def parsed(text: pa.Array) -> np.ndarray:
    """numbers.parse_repaired of each text; NaN for null."""
    out = np.full(len(text), np.nan)
    may = _has(text, rf"^[\s\v,]*[+\-.0-9{MISREAD}]")
    own = pc.replace_substring(text.filter(pa.array(may)), ",", "")
    odd = _has(own, f"[{MISREAD}]")
    if odd.any():
        own = pc.replace_with_mask(own, pa.array(odd), pa.array([_repaired(t) for t in own.filter(pa.array(odd)).to_pylist()], pa.string()))
    n = pc.utf8_ltrim(pc.struct_field(pc.extract_regex(own, _NUMBER), "n"), characters="+")
    try:
        value = n.cast(pa.float64())
    except pa.ArrowInvalid:  # beyond what a double holds
        value = pa.array([None if x is None else float(x) for x in n.to_pylist()], pa.float64())
    out[may] = value.to_numpy(zero_copy_only=False)
    return out


def _repaired(t: str) -> str:
    """numbers.repair_numeric of a text with a misread letter."""
    t = t.strip(SPACE)
    letters, digits = len(re.sub("[^A-Za-z]", "", t)), len(re.sub("[^0-9]", "", t))
    return t if letters > digits + 2 else t.translate(str.maketrans(MISREAD, "01158"))


def _taken(text: pa.Array, at: np.ndarray, there: np.ndarray) -> pa.Array:
    return text.take(pa.array(np.where(there, at, 0), mask=~there))


def _joined(text: pa.Array, at: np.ndarray, begin: np.ndarray, end: np.ndarray, by: str) -> pa.Array:
    """For each range of ``at`` its texts as one."""
    size = np.maximum(end - begin, 0)
    off = np.append(0, np.cumsum(size))
    each = np.repeat(begin - off[:-1], size) + np.arange(off[-1])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(off, pa.int32()), text.take(pa.array(at[each]))), by)


def _last_numbers(rows: Rows, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with three numbers or more whose last is over 0, at most 1e9; and where in ``rows.at`` their last three are."""
    found = np.flatnonzero(value[rows.at] >= 0)
    n = np.bincount(rows.row[found], minlength=len(rows.size))
    end = np.cumsum(n)
    good = np.flatnonzero(n >= 3)
    three = np.stack([found[end[good] - k] for k in (3, 2, 1)]) if len(good) else np.zeros((3, 0), np.int64)
    last = value[rows.at[three[2]]]
    ok = (last > 0) & (last <= 1e9)
    return good[ok], three[:, ok]


def _above(p: Page, pattern: str) -> np.ndarray:
    return _of(p.y0, p.first(_has(p.text, pattern)), 1e9)[p.bill]


def items(p: Page) -> tuple[np.ndarray, list[pa.Array]]:
    """Pages of the line items above the first total, and their columns."""
    rows = Rows(p, p.mid_y < _above(p, TOTAL) - 20, p.tolerance(15.0))
    value = parsed(p.text)
    good, three = _last_numbers(rows, value)
    begin, lead = rows.start[good], three[0] - rows.start[good]
    at = np.append(rows.at, 0)
    one = lambda i: _taken(p.text, at[np.minimum(begin + i, len(at) - 1)], lead > i)
    end = lambda k: _taken(p.text, at[begin + lead - k], lead >= k)
    fabric = pc.if_else(pa.array(lead >= 8), _joined(p.text, rows.at, begin + 4, np.where(lead >= 8, begin + lead - 3, begin), " "), one(4))
    numbers = [pa.array(value[rows.at[k]]) for k in three]
    return rows.bill[good], [pa.array(rows.ix[good], pa.int32()), one(0), one(1), one(2), one(3), fabric, end(3), end(2), end(1), *numbers]


def items_plain(p: Page) -> tuple[np.ndarray, list[pa.Array]]:
    """As items, without leading columns: rows 15 apart above the first word like a total."""
    like = spelt("T[O0D]?TAL", whole=False)
    rows = Rows(p, p.y0 < _above(p, like) - 10, np.full(p.n, 15.0))
    value = parsed(p.text)
    good, three = _last_numbers(rows, value)
    return rows.bill[good], [pa.array(rows.ix[good], pa.int32()), *[pa.array(value[rows.at[k]]) for k in three]]


def items_by_column(p: Page) -> tuple[np.ndarray, list[pa.Array]]:
    """As items: rows of ten words or more, 18 apart, by place."""
    rows = Rows(p, pc.not_equal(p.text, "").to_numpy(zero_copy_only=False), np.full(p.n, 18.0))
    good = np.flatnonzero(rows.size >= 10)
    ends = np.stack([rows.at[rows.start[good + 1] - k] for k in (3, 2, 1)]) if len(good) else np.zeros((3, 0), np.int64)
    value = [parsed(p.text.take(pa.array(e))) for e in ends]
    ok = ~np.isnan(value[0]) & ~np.isnan(value[1]) & (value[2] > 0) & (value[2] <= 1e9)
    good = good[ok]
    names = [p.text.take(pa.array(rows.at[rows.start[good] + i])) for i in range(8)]
    return rows.bill[good], [pa.array(rows.ix[good], pa.int32()), *names, *[pa.array(v[ok]) for v in value]]


def _between(p: Page, total: np.ndarray, net: np.ndarray) -> np.ndarray:
    """Words between a page's total and net total (or 600 below the total); none without a total."""
    top = _of(p.y0, total, np.nan)
    band = np.where(net >= 0, _of(p.y0, net, 0.0) + 80, top + 600) + 5
    return (p.y0 >= (top - 5)[p.bill]) & (p.y1 <= band[p.bill])


def sums(p: Page) -> tuple[np.ndarray, list[pa.Array]]:
    """Pages with decimals between total and net total, and their subtotal, cgst, sgst and net_total by size."""
    at = np.flatnonzero(_between(p, p.first(_has(p.text, TOTAL)), p.first(_has(p.text, NET_TOTAL), last=True)) & pc.match_substring(p.text, ".").to_numpy(zero_copy_only=False))
    v = parsed(p.text.take(pa.array(at)))
    some = (v < 1e7) & (v >= 0)
    v, b = v[some], p.bill[at[some]]
    down = np.lexsort((-v, b))
    v, b = v[down], b[down]

    def of(v: np.ndarray, b: np.ndarray, kth) -> np.ndarray:
        n = np.bincount(b, minlength=p.n)
        k = kth(n)
        return np.where((k >= 0) & (k < n), np.append(v, 0.0)[np.minimum(np.cumsum(n) - n + k, len(v))], np.nan)[pages]

    pages = np.unique(b)
    small = (v < 2000) & (v > 0)
    found = of(v, b, lambda n: n * 0 + 1), of(v[small], b[small], lambda n: np.maximum(n - 2, 0)), of(v[small], b[small], lambda n: n - 1), of(v, b, lambda n: n * 0)
    return pages, [pa.array(f, from_pandas=True) for f in found]


def customers(p: Page) -> tuple[np.ndarray, list[pa.Array]]:
    """Pages whose first registration number has 15 characters, and name, address, gst_no and state from the lines above it."""
    shape = spelt("[0-9][0-9][A-Z]" + "[A-Z0-9]" * 10 + "[A-Z0-9]?" * 3, exact=True)
    number, state = p.first(_has(p.text, shape)), p.first(_has(p.text, r"(?i)\(\d+\)|Tamil\s*Nadu"))
    rows = Rows(p, p.mid_y < (_of(p.mid_y, number, np.nan) - 5)[p.bill], p.tolerance(15.0), up=True)
    lines = _joined(p.text, rows.at, rows.start[:-1], rows.start[1:], " ").to_pylist()
    first = np.searchsorted(rows.bill, np.arange(p.n + 1))
    out: list[list] = [[], [], [], [], []]
    for i in np.flatnonzero(number >= 0):
        gst = re.sub(r"\s", "", p.text[number[i]].as_py(), flags=re.ASCII)
        if len(gst) == 15:
            own = lines[first[i] : first[i + 1]]
            name = next((x for x in own if len(x) <= 80 and len(re.findall("[A-Z]", x)) >= 2), None)
            address = own[1:] if name is None else [x for x in own if x != name]
            code = re.search(r"\(([0-9]+)\)", p.text[state[i]].as_py()) if state[i] >= 0 else None
            where = code[1] if code else "Tamil Nadu" if state[i] >= 0 else None
            for column, value in zip(out, (i, name if name is not None else own[0] if own else None, ", ".join(address), gst, where)):
                column.append(value)
    return np.array(out[0], np.int64), [pa.array(c, pa.string()) for c in out[1:]]


def _top(p: Page) -> np.ndarray:
    """Words that begin in the top 28 % of their page (lowest word and 50)."""
    low = np.full(p.n, -np.inf)
    some = np.flatnonzero(np.diff(p.off))
    if len(some):
        low[some] = np.maximum.reduceat(p.y1, p.off[some])
    return p.y0 < ((low + 50) * 28 / 100)[p.bill]


def bill_numbers(p: Page) -> tuple[np.ndarray, list[pa.Array]]:
    """Pages with words in their top 28 %, and what stands right of a "No" there, else the first number there, else null."""
    top = _top(p)
    at = _ordered(np.flatnonzero(top), p.bill, p.ix)
    begin = np.searchsorted(p.bill[at], np.arange(p.n + 1))
    lone = p.first(top & _has(p.text, r"^[0-9]{1,6}\z"))
    number = _taken(p.text, lone, lone >= 0).to_pylist()
    tolerance, labelled = p.tolerance(10.0), set()
    for label in at[_has(p.text.take(pa.array(at)), LABEL)]:
        i = p.bill[label]
        own = at[begin[i] : begin[i + 1]]
        line = own[np.abs(p.mid_y[own] - p.mid_y[label]) < tolerance[i]]
        right = line[p.mid_x[line] > p.mid_x[label]]
        if i not in labelled and len(right) and not re.search(r"(?i)GST\s*No", " ".join(p.text.take(pa.array(line)).to_pylist()), re.ASCII):
            value = _bill_no(p.text[right[np.lexsort((p.ix[right], p.mid_x[right]))[0]]].as_py())
            if value is not None:
                number[i] = value
                labelled.add(i)
    pages = np.flatnonzero(np.diff(begin))
    return pages, [pa.array(number, pa.string()).take(pa.array(pages))]


def _bill_no(t: str) -> str | None:
    plain = t.replace(",", "")
    if re.fullmatch("[0-9]{1,6}", plain):
        return plain
    digits = re.sub("[^0-9]", "", _repaired(t) if re.search(f"[{MISREAD}]", t) else t)
    return digits if 1 <= len(digits) <= 6 else None


def word_rows(p: Page) -> tuple[np.ndarray, list[pa.Array]]:
    """Pages, numbers and rows of all words."""
    rows = Rows(p, np.ones(len(p.bill), bool), p.tolerance(15.0))
    return rows.bill[rows.row], [pa.array(p.ix[rows.at]), pa.array(rows.ix[rows.row])]


def _labels(p: Page) -> np.ndarray:
    """Of pages that have one, the first "No" in the top 28 % that is not on a line of a registration number, and the word next to its right."""
    top = _top(p)
    at = _ordered(np.flatnonzero(top), p.bill, p.ix)
    begin = np.searchsorted(p.bill[at], np.arange(p.n + 1))
    text = p.text.take(pa.array(at))
    todo = at[_has(text, LABEL, _plain(pc.less_equal(pc.binary_length(text), 3)))]
    tolerance, found = p.tolerance(10.0), [np.zeros(0, np.int64)]
    while len(todo):  # the first label of each page, then the next one of pages whose first has none, and so on
        page = p.bill[todo]
        lead = np.append(True, page[1:] != page[:-1])
        label, page = todo[lead], page[lead]
        size = begin[page + 1] - begin[page]
        of = np.repeat(np.arange(len(label)), size)
        word = at[np.arange(len(of)) + np.repeat(begin[page] - np.cumsum(size) + size, size)]
        line = np.abs(p.mid_y[word] - p.mid_y[label][of]) < tolerance[page][of]
        of, word = of[line], word[line]
        end = np.searchsorted(of, np.arange(len(label) + 1))
        gst = _has(_joined(p.text, word, end[:-1], end[1:], " "), r"[Gg][Ss][Tt]\s*[Nn][Oo]")
        right = (p.mid_x[word] > p.mid_x[label][of]) & ~gst[of]
        of, word = of[right], word[right]
        near = np.lexsort([p.ix[word], p.mid_x[word], of])
        own, first = np.unique(of[near], return_index=True)
        found.append(np.stack([label[own], word[near[first]]], 1).ravel())
        todo = todo[~lead]
        todo = todo[~np.isin(p.bill[todo], page[own])]
    return np.concatenate(found)


def zones(p: Page) -> tuple[np.ndarray, list[pa.Array]]:
    """Pages, zones, rows and boxes of the words that the functions above look at."""
    total, net = p.first(_has(p.text, TOTAL, _begins(p.text, "T"))), p.first(_has(p.text, NET_TOTAL, _begins(p.text, "N")), last=True)
    number = p.first(_has(p.text, SHAPE, _plain(pc.greater_equal(pc.binary_length(p.text), 13))))
    bare = pc.replace_substring_regex(_taken(p.text, number, number >= 0), ANY_SPACE, "")
    whole = pc.fill_null(pc.equal(pc.utf8_length(bare), 15), False).to_numpy(zero_copy_only=False)
    customer = p.mid_y < (np.where(whole, _of(p.mid_y, number, np.nan), np.nan) - 5)[p.bill]
    rows = Rows(p, p.mid_y < _of(p.y0, total, 1e9)[p.bill] - 20, p.tolerance(15.0))
    words = [_labels(p), np.flatnonzero(customer), np.flatnonzero(_between(p, total, net)), rows.at]
    at = np.concatenate(words)
    zone = pa.concat_arrays([pa.repeat(name, len(w)) for name, w in zip(ZONES, words)])
    row = pa.concat_arrays([pa.nulls(len(at) - len(rows.at), pa.int64()), pa.array(rows.ix[rows.row])])
    return p.bill[at], [zone, row, *[pa.array(c[at]) for c in (p.x0, p.y0, p.x1, p.y1)]]


ITEMS = ("row_ix", "sl_no", "dc", "date", "gg", "fabric", "counts", "mill", "dia", "weight", "rate", "amount")


def said(p: Page) -> tuple[np.ndarray, list[pa.Array]]:
    """Of each page what sums, customers, items and bill_numbers find, null where they find nothing."""
    def one(found: tuple[np.ndarray, list[pa.Array]], *names: str) -> pa.Array:
        at = np.full(p.n, -1)
        at[found[0]] = np.arange(len(found[0]))
        value = pa.StructArray.from_arrays(found[1], names) if names else found[1][0]
        return value.take(pa.array(np.maximum(at, 0), mask=at < 0))

    bill, columns = items(p)
    each = pa.ListArray.from_arrays(pa.array(np.searchsorted(bill, np.arange(p.n + 1)), pa.int32()), pa.StructArray.from_arrays(columns, ITEMS))
    return np.arange(p.n), [one(sums(p), "subtotal", "cgst", "sgst", "net_total"), one(customers(p), "name", "address", "gst_no", "state"), each, one(bill_numbers(p))]
