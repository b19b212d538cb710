"""Benchmark decontamination by template canonicalisation.

Texts become sequences of template words, twice: words are lower-cased and parted by anything that is neither
letter nor digit; numbers (digits or number words), names (capitalised inside a sentence) and units after
a number become typed placeholders, runs of numbers or of names one; the other sequence has names as words, as
case may have changed, or a sentence begin where the item does. Windows of WIDTH template words are
hash-joined with those of the benchmark's items, and an item counts as found in a document if, along one
alignment, enough of its windows match and the slots are consistent: equal values in the item stand for
equal values in the document and different ones for different ones. So a question with other numbers or
names is found, while texts that only share a shape aren't: a window must hold LITERALS words that
aren't placeholders. "Enough" is half of an item's windows, or ENOUGH of them, that is a passage of ENOUGH + WIDTH - 1 words: this holds for
items of any length. Items of fewer than WIDTH template words, LITERALS or more of them literal, are one window of their own length, found with consistent
values. Items without any such window (still shorter ones, and those dense with numbers, names or units) are
found wherever all their words stand in a row, with the very same values: also a single word, if that is an item.

The benchmark is a stated query set. One of at most BROADCAST_BYTES of text is taken in blocks of BLOCK_BYTES, each of which goes to
all executors once; every document is compared with every block in one pass. A larger one is hash-joined by Spark: windows of its items, and
those windows of the documents that a bitmap of fixed size (of all items' windows) lets through, meet by equal hashes, and each pair of a text and
an item that meet is then compared as above; nothing of the benchmark goes through the driver but the bitmap.

Null and empty texts have no windows: such documents are clean and such items never found. Null ids are kept as
they are. An item that occurs several times in a document is reported once. Repeated rows give repeated
results, empty tables empty ones.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import Scratch, cut, ship, unused
from eventloom.llm.hashing import LOWER, blocks, hashes, mix, windows, words
from eventloom.llm.toxicity import APART

WIDTH, LITERALS = 8, 4
#: An item is found if this share of its windows match, or this many.
SHARE, ENOUGH = 0.5, 12
BLOCK_BYTES, BROADCAST_BYTES = 8 << 20, 64 << 20
#: Bits by which a window's hash has a place in the bitmap; blocks of single items that a task keeps.
BITMAP_BITS, KEPT_BLOCKS = 24, 512

# Names of numbers and of units.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen"
UNITS = "mm cm m km inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers centimetre centimetres centimeter centimeters mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent degree degrees celsius fahrenheit kelvin joule joules watt watts volt volts amp amps hz khz mhz ghz kb mb gb tb byte bytes bit bits dollar dollars euro euros cent cents usd eur gbp kmh mph"

PLAIN, NUMBER, NAME, UNIT = 0, 1, 2, 3
_TYPED = np.array([0, 0x5BD1E9955BD1E995, 0x1B8735939E3779B9, 0x27D4EB2F165667C5], np.uint64)


def _hash_list(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    begin, end, _ = words(data, np.array([0, len(data)]))
    return np.sort(hashes(data, begin, end))


_NUMBER_HASHES, _UNIT_HASHES = _hash_list(NUMBERS), _hash_list(UNITS)
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?:;\n\r\"()[]{}|>*#")] = True


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


@dataclass
class Templates:
    """Template words of a block of texts: hash (placeholders by type), type, hash of the value; first word of each text."""

    word: np.ndarray
    kind: np.ndarray
    value: np.ndarray
    first: np.ndarray


def _lowered(data: np.ndarray) -> np.ndarray:
    lower = LOWER[data]
    if len(data) > 1:  # capital letters of Latin-1
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
        lower[capital] += 32
    return lower


def templates(data: np.ndarray, starts: np.ndarray) -> list[Templates]:
    """With names as placeholders, and with names as words."""
    lower = _lowered(data)
    begin, end, first = words(data, starts, APART)
    n = len(begin)
    value = hashes(lower, begin, end)
    if not n:
        return [Templates(value, np.zeros(0, np.int8), value, first)] * 2
    head = data[begin]
    second = data[np.minimum(begin + 1, len(data) - 1)]
    wide = (head == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    capitals = (data >= 65) & (data <= 90)
    capitals[:-1] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    capitals = np.concatenate([[0], np.cumsum(capitals)])
    # one capital, at the start of two characters or more: a shouted text has no names
    is_capital = ((head >= 65) & (head <= 90) | wide) & (capitals[end] - capitals[begin] == 1) & (end - begin > 1 + wide)
    stops = np.concatenate([[0], np.cumsum(_STOPS[data])])
    opening = np.ones(n, bool)
    opening[1:] = stops[begin[1:]] > stops[end[:-1]]
    opening[first[:-1][first[:-1] < n]] = True
    kind = np.zeros(n, np.int8)
    kind[is_capital & ~opening] = NAME
    kind[(head >= 48) & (head <= 57) | _among(value, _NUMBER_HASHES)] = NUMBER
    units = np.flatnonzero((kind[1:] != NUMBER) & (kind[:-1] == NUMBER) & ~opening[1:]) + 1
    units = units[_among(value[units], _UNIT_HASHES)]
    kind[units] = UNIT
    return [_merged(value, kind, first), _merged(value, np.where(kind == NAME, np.int8(PLAIN), kind), first)]


def _merged(value: np.ndarray, kind: np.ndarray, first: np.ndarray) -> Templates:
    """A run of numbers, or of names, is one placeholder whose value is all of them."""
    n = len(value)
    keep = np.ones(n, bool)
    keep[1:] = ~((kind[1:] == kind[:-1]) & ((kind[1:] == NUMBER) | (kind[1:] == NAME)))
    keep[first[:-1][first[:-1] < n]] = True
    at = np.flatnonzero(keep)
    total = value[at].copy()
    gone = np.flatnonzero(~keep)
    if len(gone):
        group = np.searchsorted(at, gone, "right") - 1
        np.add.at(total, group, value[gone] * (2 * (gone - at[group]).astype(np.uint64) + np.uint64(1)))
    kind = kind[at]
    word = np.where(kind == PLAIN, total, _TYPED[kind])
    return Templates(word, kind, total, np.searchsorted(at, first))


@dataclass
class Items:
    """A block of the benchmark in one of the two sequences, with its windows sorted by hash."""

    made: Templates
    hash: np.ndarray
    item: np.ndarray
    at: np.ndarray
    n_windows: np.ndarray
    maybe: np.ndarray
    #: Items shorter than a window, by length: hash of the whole (sorted), item.
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def _windows(t: Templates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word (within the text) of each window with enough literal words, and of each short text."""
    found, owner = windows(t.word, t.first, WIDTH)
    counts = np.diff(t.first)
    made = np.bincount(owner, minlength=len(counts))
    at = np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made)
    plain = np.concatenate([[0], np.cumsum(t.kind == PLAIN)])
    low = t.first[owner] + at
    literal = plain[np.minimum(low + WIDTH, t.first[owner + 1])] - plain[low]
    good = (literal >= LITERALS) | (counts[owner] < WIDTH)
    return found[good], owner[good], at[good]


@dataclass
class Exact:
    """Items that must occur word for word, by the largest power of two up to their length: hash of so many first words (sorted), of so many last ones, length, item."""

    groups: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


@dataclass
class Block:
    ids: list
    kinds: list[Items]
    exact: Exact


def _raw(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, nothing being a placeholder; first word of each text."""
    begin, end, first = words(data, starts, APART)
    return hashes(_lowered(data), begin, end), first


def _doubled(value: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(width, hashes of all runs of so many words) for the powers of two up to most; runs may cross texts."""
    width = 1
    while width <= most and len(value):
        yield width, value
        value = mix(value[:-width] + mix(value[width:] ^ np.uint64(width)))
        width *= 2


def _exact_items(value: np.ndarray, first: np.ndarray, which: np.ndarray) -> Exact:
    size = np.diff(first)
    which = which[size[which] > 0]
    groups = {}
    for width, run in _doubled(value, int(size[which].max(initial=0))):
        here = which[(size[which] >= width) & (size[which] < 2 * width)]
        if len(here):
            head = run[first[here]]
            order = np.argsort(head, kind="stable")
            here = here[order]
            groups[width] = head[order], run[first[here] + size[here] - width], size[here], here
    return Exact(groups)


def _whole(value: np.ndarray, first: np.ndarray, exact: Exact) -> np.ndarray:
    """(row, item) of exact items in texts, each once. First and last words of an item overlap or meet, so both together are all of it."""
    out = [np.zeros((0, 2), np.int64)]
    ends = np.repeat(first[1:], np.diff(first))
    for width, run in _doubled(value, max(exact.groups, default=0)):
        if width not in exact.groups:
            continue
        head, tail, size, item = exact.groups[width]
        at = np.flatnonzero(_among(run, head))
        low, high = np.searchsorted(head, run[at], "left"), np.searchsorted(head, run[at], "right")
        n = high - low
        at = np.repeat(at, n)
        k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        inside = at + size[k] <= ends[at]
        at, k = at[inside], k[inside]
        same = run[at + size[k] - width] == tail[k]
        out.append(np.stack([np.searchsorted(first, at[same], "right") - 1, item[k[same]]], 1))
    return np.unique(np.concatenate(out), axis=0)


def prepare(ids: list, texts: list[str]) -> Block:
    column = pa.array([t or "" for t in texts], pa.large_string())
    size = sum(len(t.encode()) for t in texts if t)
    parts = []
    for low, high, data, starts in blocks(column, size + 1):
        parts.append((low, high, templates(data, starts), _raw(data, starts)))
    out = []
    lacks = np.zeros(len(ids), bool)
    for which in range(2):
        # blocks have bounded rows, so several may have to be put together
        made = [p[2][which] for p in parts]
        sizes = np.cumsum([0, *(len(m.word) for m in made)])
        first = np.concatenate([*(m.first[:-1] + s for m, s in zip(made, sizes, strict=False)), sizes[-1:]])
        one = Templates(*(np.concatenate([getattr(m, name) for m in made]) for name in ("word", "kind", "value")), first)
        found, owner, at = _windows(one)
        size = np.diff(first)
        full = np.bincount(owner[size[owner] >= WIDTH], minlength=len(ids))
        lacks |= full == 0
        plain = np.concatenate([[0], np.cumsum(one.kind == PLAIN)])
        literal = plain[first[1:]] - plain[first[:-1]]
        short = {}
        for width in range(LITERALS + 1, WIDTH):
            which_ = np.flatnonzero((size == width) & (literal >= LITERALS) & (literal < width))
            if len(which_):
                value, of = windows(one.word, one.first, width)
                value = value[np.isin(of, which_)]  # one window each, in the order of the items
                order = np.argsort(value, kind="stable")
                short[width] = value[order], which_[order]
        order = np.argsort(found, kind="stable")
        maybe = np.zeros(1 << 20, bool)
        maybe[found >> np.uint64(44)] = True
        out.append(Items(one, found[order], owner[order], at[order], np.bincount(owner, minlength=len(ids)), maybe, short))
    sizes = np.cumsum([0, *(len(p[3][0]) for p in parts)])
    first = np.concatenate([*(p[3][1][:-1] + s for p, s in zip(parts, sizes, strict=False)), sizes[-1:]])
    return Block(ids, out, _exact_items(np.concatenate([p[3][0] for p in parts]), first, np.flatnonzero(lacks)))


def matches(column: pa.Array, block: Block) -> Iterator[tuple[int, int, int, int, bool]]:
    """(row, item, windows matched, windows of the item, whether slots have other values) for items found in texts."""
    for low, _, data, starts in blocks(column):
        best: dict[tuple[int, int], tuple[int, int, bool]] = {}
        for made, items in zip(templates(data, starts), block.kinds, strict=True):
            for row, item, n, of, changed in _aligned(made, items):
                if n > best.get((row, item), (0, 0, False))[0]:
                    best[row, item] = n, of, changed
        if block.exact.groups:
            for row, item in _whole(*_raw(data, starts), block.exact).tolist():
                of = max(1, *(int(k.n_windows[item]) for k in block.kinds))
                best.setdefault((row, item), (of, of, False))
        for (row, item), found in sorted(best.items()):
            yield low + row, item, *found


def _aligned(made: Templates, items: Items) -> Iterator[tuple[int, int, int, int, bool]]:
    yield from _short(made, items)
    found, owner, at = _windows_maybe(made, items)
    if not len(found):
        return
    left, right = np.searchsorted(items.hash, found, "left"), np.searchsorted(items.hash, found, "right")
    aligned: dict[tuple[int, int, int], set[int]] = defaultdict(set)
    for row, place, a, b in zip(owner.tolist(), at.tolist(), left.tolist(), right.tolist(), strict=True):
        for k in range(a, b):
            aligned[row, int(items.item[k]), place - int(items.at[k])].add(int(items.at[k]))
    for (row, item, shift), places in aligned.items():
        of = int(items.n_windows[item])
        least = min(SHARE * of, ENOUGH)
        if len(places) < least:
            continue
        same, first = _consistent(made, items.made, row, item, shift, places)
        if same is None:
            # a word before the item may have run into its first name: without the windows of that slot
            places = {p for p in places if p > first}
            if len(places) < max(1, least):
                continue
            same, _ = _consistent(made, items.made, row, item, shift, places)
        if same is not None:
            yield row, item, len(places), of, not same


def _short(made: Templates, items: Items) -> Iterator[tuple[int, int, int, int, bool]]:
    """Items shorter than a window, with consistent values."""
    counts = np.diff(made.first)
    for width, (value, which) in items.short.items():
        found, owner = windows(made.word, made.first, width)
        n = np.bincount(owner, minlength=len(counts))
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        here = np.flatnonzero(_among(found, value) & (counts[owner] >= width))
        left, right = np.searchsorted(value, found[here], "left"), np.searchsorted(value, found[here], "right")
        for i, a, b in zip(here.tolist(), left.tolist(), right.tolist(), strict=True):
            for item in which[a:b].tolist():
                same, _ = _slots(made, items.made, int(made.first[owner[i]]) + int(at[i]), int(items.made.first[item]), range(width))
                if same is not None:
                    yield int(owner[i]), item, 1, 1, not same


def _windows_maybe(made: Templates, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, owner, at = _windows(made)
    here = np.flatnonzero(items.maybe[found >> np.uint64(44)])
    found, owner, at = found[here], owner[here], at[here]
    good = _among(found, items.hash) if len(items.hash) else np.zeros(len(found), bool)
    return found[good], owner[good], at[good]


def _consistent(text: Templates, items: Templates, row: int, item: int, shift: int, places: set[int]) -> tuple[bool | None, int]:
    """What _slots says of the words that the places cover; a text of fewer words than a window must have the very same values."""
    size = int(items.first[item + 1] - items.first[item])
    same, first = _slots(text, items, int(text.first[row]) + shift, int(items.first[item]), sorted({p + k for p in places for k in range(min(WIDTH, size))}))
    if size < WIDTH and not same:
        return None, size
    return same, size if first is None else first


def _slots(text: Templates, items: Templates, of_text: int, of_item: int, covered: Iterable[int]) -> tuple[bool | None, int | None]:
    """None: the slots contradict one another. Else whether all values are the same. And where the first slot is, if that is a name."""
    there, back, same, first = {}, {}, True, -1
    for k in covered:
        kind = int(items.kind[of_item + k])
        if kind == PLAIN:
            continue
        if first == -1:
            first = k if kind == NAME else None
        a, b = (kind, int(items.value[of_item + k])), (kind, int(text.value[of_text + k]))
        if there.setdefault(a, b) != b or back.setdefault(b, a) != a:
            return None, first
        same &= a == b
    return same, first


def _item_blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[Block]:
    ids, texts, size = [], [], 0
    for row in benchmark.select(benchmark[key], benchmark[text]).where(benchmark[text].isNotNull()).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1].encode())
        if size >= BLOCK_BYTES:
            yield prepare(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield prepare(ids, texts)


def _broadcast(benchmark: DataFrame, text: str) -> bool:
    return (benchmark.agg(F.sum(F.octet_length(benchmark[text]))).first()[0] or 0) <= BROADCAST_BYTES


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item, n_matched, n_windows, reparameterised: one row for each item found in a document."""
    ship(docs.sparkSession)
    of = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"`{key}` {of(docs, key)}, `{item}` {of(benchmark, item)}, n_matched bigint, n_windows bigint, reparameterised boolean"
    names = [key, item, "n_matched", "n_windows", "reparameterised"]
    if not _broadcast(benchmark, item_text):
        with Scratch(docs.sparkSession) as work:
            found = _joined(docs.select(docs[key].alias("key"), docs[text].alias("text")), benchmark, item, item_text, work)
            return cut(found.select("key", "item", *names[2:]).toDF(*names))
    kind, held = _arrow(benchmark, item), [docs.sparkSession.sparkContext.broadcast(block) for block in _item_blocks(benchmark, item, item_text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in held:
                got = list(matches(batch.column(1), block.value))
                rows, found, n, of_, changed = map(list, zip(*got, strict=True)) if got else ([], [], [], [], [])
                ids = pa.array([block.value.ids[i] for i in found], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), ids, pa.array(n, pa.int64()), pa.array(of_, pa.int64()), pa.array(changed, pa.bool_())], names)

    return docs.select(docs[key], docs[text].alias("__text")).mapInArrow(run, schema)


def _item_keys(block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(tag, keys, items): a text in which an item of the block is found has one of the item's keys among those of the tag."""
    for kind, items in enumerate(block.kinds):
        yield kind, items.hash, items.item
        for width, (value, which) in items.short.items():
            yield 2 * width + kind, value, which
    for width, (head, _, _, which) in block.exact.groups.items():
        yield 100 + width, head, which


def _text_keys(data: np.ndarray, starts: np.ndarray, tags: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(tag, keys, the row of each) of a block of texts."""
    for kind, made in enumerate(templates(data, starts)):
        found, owner, _ = _windows(made)
        yield kind, found, owner
        for width in range(LITERALS + 1, WIDTH):
            if 2 * width + kind in tags:
                yield 2 * width + kind, *windows(made.word, made.first, width)
    widths = [t - 100 for t in tags if t > 100]
    value, first = _raw(data, starts)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(first))
    for width, run in _doubled(value, max(widths, default=0)):
        if width in widths:
            inside = owner[: len(run)] == owner[width - 1 :]
            yield 100 + width, run[inside], owner[: len(run)][inside]


def _tagged(tag: int, keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ (np.uint64(tag) * np.uint64(0x9E3779B97F4A7C15)))


def _joined(docs: DataFrame, benchmark: DataFrame, item: str, item_text: str, work: Scratch) -> DataFrame:
    """key, text, item and what matches() says, for each row of docs (key, text) and item found in it, by a hash join."""
    spark = docs.sparkSession
    items = work.cut(benchmark.select(benchmark[item].alias("item"), benchmark[item_text].alias("item_text")).where("item_text IS NOT NULL").withColumn("u", F.monotonically_increasing_id()))

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_numpy()
            for tag, keys, which in _item_keys(prepare(ids.tolist(), batch.column(0).to_pylist())):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), tag, np.int32)), pa.array(_tagged(tag, keys).view(np.int64)), pa.array(ids[which])], ["tag", "h", "u"])

    keyed = work.cut(items.select("item_text", "u").mapInArrow(of_items, "tag int, h bigint, u bigint").distinct())
    tags = [r["tag"] for r in keyed.select("tag").distinct().collect()]  # a few widths
    place = F.shiftrightunsigned("h", 64 - BITMAP_BITS) + 1
    parts = keyed.groupBy(F.bitmap_bucket_number(place).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()  # one bit for each place
    bits = np.zeros((1 << BITMAP_BITS) + (1 << 15), bool)
    for part in parts:
        own = np.unpackbits(np.frombuffer(part["bits"], np.uint8), bitorder="little").astype(bool)
        low = (part["n"] - 1) * (1 << 15)
        bits[low : low + len(own)] |= own
    held = spark.sparkContext.broadcast(np.packbits(bits[: 1 << BITMAP_BITS], bitorder="little"))

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            one, two = (batch.column(i).to_numpy() for i in (1, 2))
            for low, _, data, starts in blocks(batch.column(0)):
                for tag, keys, row in _text_keys(data, starts, tags):
                    keys = _tagged(tag, keys)
                    at = (keys >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                    here = np.flatnonzero((known[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                    rows = low + row[here]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[here].view(np.int64)), pa.array(one[rows]), pa.array(two[rows])], ["h", "t1", "t2"])

    texts = docs.where("text IS NOT NULL").withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    windowed = texts.select("text", "t1", "t2").mapInArrow(of_texts, "h bigint, t1 bigint, t2 bigint")
    met = work.cut(windowed.join(keyed.select("h", "u"), "h").select("t1", "t2", "u").distinct())
    pairs = texts.join(met, ["t1", "t2"]).join(items, "u").select("text", "item_text", "u", "key", "item")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared: dict[int, Block] = {}
        for batch in batches:
            out: list[tuple] = []
            for i, (text, item_text_, u) in enumerate(zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True)):
                if u not in prepared:
                    if len(prepared) >= KEPT_BLOCKS:
                        prepared.clear()
                    prepared[u] = prepare([0], [item_text_.as_py()])
                out += [(i, n, of_, changed) for _, _, n, of_, changed in matches(pa.array([text.as_py()]), prepared[u])]
            rows, n, of_, changed = map(list, zip(*out, strict=True)) if out else ([], [], [], [])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(3).take(at), batch.column(0).take(at), batch.column(4).take(at), pa.array(n, pa.int64()), pa.array(of_, pa.int64()), pa.array(changed, pa.bool_())], ["key", "text", "item", "n_matched", "n_windows", "reparameterised"])

    of = lambda df, c: df.schema[c].dataType.simpleString()
    return pairs.mapInArrow(compare, f"key {of(docs, 'key')}, text string, item {of(items, 'item')}, n_matched bigint, n_windows bigint, reparameterised boolean")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents (all columns) in which no item is found: by filters inside one pass over them, or, for a large benchmark, without the texts that the hash join finds."""
    ship(docs.sparkSession)
    if not _broadcast(benchmark, item_text):
        one, two = unused(docs.columns, "__t1", "__t2")
        with Scratch(docs.sparkSession) as work:
            found = _joined(docs.select(F.lit(0).alias("key"), docs[text].alias("text")), benchmark, item, item_text, work)
            gone = cut(found.select(F.xxhash64("text").alias(one), F.xxhash64(F.lit(1), "text").alias(two)).distinct())
        return docs.withColumns({one: F.xxhash64(text), two: F.xxhash64(F.lit(1), text)}).join(gone, [one, two], "left_anti").select(docs.columns)
    at, names = docs.columns.index(text), docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    held = [docs.sparkSession.sparkContext.broadcast(block) for block in _item_blocks(benchmark, item, item_text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.ones(batch.num_rows, bool)
            for block in held:
                good[[m[0] for m in matches(batch.column(at), block.value)]] = False
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns], names)

    return docs.mapInArrow(run, schema)
