"""Deeply nested records into related flat tables, by shared inlining.

``schema_graph`` reads every record and reduces it to the graph of its element
types: which element holds which, how often at most, and with what attributes.
``inline_plan`` decides from the graph: an element that repeats, has several
kinds of parents or can hold itself gets a table; any other is inlined into its
parent as prefixed columns. ``shred`` turns the records into rows that carry
the key of every ancestor, and ``tables`` gives one DataFrame a planned element
with its own key and its foreign keys, so no join is needed to number children.

A grammar says only what the keys mean: which ones hold which element, which
are wrappers, and how an element is numbered. Unknown objects are elements
named after their key. Records are walked with an explicit stack, so their
depth has no limit.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.runtime import cut_lineage

#: An element with more distinct names below it than this is open: its keys are
#: data, so they become rows (path, value) of a table instead of columns.
MAX_EDGES = 5_000


@dataclass(frozen=True)
class Holds:
    """A key holds one ``element`` (its whole value), or with ``many`` each item
    of its list; the first has the place ``offset``."""

    element: str
    many: bool = True
    offset: int = 0


@dataclass(frozen=True)
class Element:
    """keys: key -> Holds, or None where the key's value stands for the element
    itself. wrappers: keys of an object that only wraps a list of this element.
    items: what a list in place of the element holds. bare: element that an
    object with one of these keys is, in place of this one. positional: names
    for the parts of a plain value or list. order: attribute with the own
    number. per_record: numbered through the record, else by place."""

    keys: Mapping[str, Holds | None] = field(default_factory=dict)
    wrappers: tuple[str, ...] = ()
    items: Holds | None = None
    bare: tuple[tuple[str, ...], str] | None = None
    positional: tuple[str, ...] = ()
    order: str | None = None
    per_record: bool = False

    @property
    def leaf(self) -> bool:
        """It can hold no other element of the grammar."""
        return not (self.wrappers or self.items or self.bare or self.per_record or any(self.keys.values()))


Grammar = Mapping[str, Element]

_GAP = re.compile(r"[ \t\n\r]*")
_PLAIN = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity")
_NAMED = {"true": True, "false": False, "null": None}


def _read_deep(body: str) -> object:
    """JSON of any depth, with an explicit stack; numbers stay text."""
    at = _GAP.match(body).end()
    stack: list[tuple[object, str | None]] = []  # open containers, and the key each waits with
    holder, key, value = None, None, None
    while True:
        if at >= len(body):
            raise ValueError("ends early")
        sign, done = body[at], True
        if sign == '"':
            value, at = scanstring(body, at + 1, True)
        elif sign in "{[":
            stack.append((holder, key))
            holder, key = ({} if sign == "{" else []), None
            at = _GAP.match(body, at + 1).end()
            done = body[at : at + 1] == ("}" if sign == "{" else "]")
        else:
            m = _PLAIN.match(body, at)
            if not m:
                raise ValueError(f"no value at {at}")
            value, at = _NAMED.get(m[0], m[0]), m.end()
        while done:  # a value has ended: it goes to its holder, which may end too
            if sign in "{[}]":
                value, at = holder, at + 1
                holder, key = stack.pop()
            if holder is None:
                if _GAP.match(body, at).end() != len(body):
                    raise ValueError("text after the value")
                return value
            if isinstance(holder, list):
                holder.append(value)
            else:
                holder[key] = value
            at = _GAP.match(body, at).end()
            sign = body[at : at + 1]
            if sign == ",":
                at, done = _GAP.match(body, at + 1).end(), False
            elif sign != ("]" if isinstance(holder, list) else "}"):
                raise ValueError(f"no comma at {at}")
        if isinstance(holder, dict):
            if body[at : at + 1] != '"':
                raise ValueError(f"no key at {at}")
            key, at = scanstring(body, at + 1, True)
            at = _GAP.match(body, at).end()
            if body[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            at = _GAP.match(body, at + 1).end()


def read_json(body: str) -> object:
    """The value of a JSON text, numbers as text; ValueError where it is none."""
    try:
        return json.loads(body, parse_float=str, parse_int=str, parse_constant=str)
    except RecursionError:
        return _read_deep(body)


class _Node:
    """An element's instance while its content is walked."""

    __slots__ = ("attrs", "element", "extra", "home", "keys", "tally")

    def __init__(self, element: str, home: str, keys: tuple, extra: dict, attrs: dict):
        self.element, self.home, self.keys, self.extra, self.attrs = element, home, keys, extra, attrs
        self.tally: dict[str, int] = defaultdict(int)


class _Walker:
    """The elements of records in document order, parents first, as columns;
    with ``graph``, the edges between them instead."""

    def __init__(self, grammar: Grammar, only: frozenset[str] | None = None, attributes: bool = True, graph: bool = False):
        self.grammar, self.only, self.names = grammar, only, list(grammar)
        self.at = {n: i for i, n in enumerate(self.names)}
        self.fallback = Element()
        self.leaves = {n for n, e in grammar.items() if e.leaf}
        self.attributes, self.graph = attributes or graph, graph
        self.steps = (self._content, self._each, self._one, self._element)
        self.clear()

    def clear(self) -> None:
        self.elements: list[str] = []
        self.keys: list[list] = [[] for _ in self.names]
        self.places: list[int] = []
        self.parents: list[int | None] = []
        self.attrs: list[dict] = []
        self.held: dict[tuple[str, str, str], int] = {}  # (home, parent, child) -> most
        self.paths: set[tuple[str, str, str]] = set()  # (home, element, attribute's path)

    def record(self, body: str | None, root: str) -> int:
        """Walk one record; how many rows it has."""
        before = len(self.elements)
        self.count: dict[str, int] = defaultdict(int)
        keys = tuple(0 if n == root else None for n in self.names)
        node = _Node(root, root, keys, {}, {})
        self._emit(root, keys, 0, None, node.attrs)
        if self.graph:
            self.held[root, "", root] = 1
        if body is not None:
            try:
                value = read_json(body)
            except ValueError as e:
                node.attrs["_invalid"] = type(e).__name__
                self._note(node)
            else:
                self.stack: list[tuple] = [(0, node, value, "")]
                while self.stack:
                    step = self.stack.pop()
                    self.steps[step[0]](*step[1:])
        return len(self.elements) - before

    def _note(self, node: _Node) -> None:
        if self.graph:
            self.paths.update((node.home, node.element, path) for path in node.attrs)
            node.attrs.clear()

    def _emit(self, element: str, keys: tuple, place: int, parent: int | None, attrs: dict) -> None:
        if not self.graph and (self.only is None or element in self.only):
            self.elements.append(element)
            for column, k in zip(self.keys, keys):
                column.append(k)
            self.places.append(place)
            self.parents.append(parent)
            self.attrs.append(attrs)

    def _each(self, node: _Node, holds: Holds, value: object) -> None:
        """The elements that a value holds; bare ones count as a list of one."""
        if value is None or value == {}:
            return
        if not holds.many:
            self._element(node, holds.element, value, holds.offset)
        elif isinstance(value, list):
            if holds.element in self.leaves and self._bulk(node, holds, value):
                return
            self.stack += [(2, node, holds, item, i + holds.offset) for i, item in reversed(list(enumerate(value))) if item is not None]
        else:
            self._one(node, holds, value, holds.offset)

    def _bulk(self, node: _Node, holds: Holds, items: list) -> bool:
        """All of a list's leaf elements at once; False where one holds more than plain values."""
        element, spec = holds.element, self.grammar[holds.element]
        attrs: list[dict] = [{}] * len(items)
        if self.attributes or self.only is None:
            found = [None if item is None else self._flat(spec, item) for item in items]
            if any(f is None and item is not None for f, item in zip(found, items)):
                return False
            if self.attributes:
                attrs = found
        places, order = range(holds.offset, holds.offset + len(items)), spec.order
        numbers = [self._number(item, order, i) for i, item in zip(places, items) if item is not None]
        if self.graph:
            self._hold(node, element, len(numbers))
            self.paths.update((element, element, k) for k in set().union(*[a for a in attrs if a]))
        elif self.only is None or element in self.only:
            n, own = len(numbers), self.at[element]
            self.elements += [element] * n
            for i, column in enumerate(self.keys):
                column += numbers if i == own else [node.keys[i]] * n
            self.places += numbers
            self.parents += [node.keys[own]] * n
            self.attrs += [a for a, item in zip(attrs, items) if item is not None]
        return True

    def _flat(self, spec: Element, item: object) -> dict | None:
        """The attributes of a leaf element of plain values, else None."""
        if isinstance(item, dict):
            found = {}
            for k, v in item.items():
                if k in spec.keys:
                    inner = {} if v is None else self._flat(spec, v)
                    if inner is None:
                        return None
                    found |= inner
                elif isinstance(v, (dict, list)):
                    return None
                elif v is not None:
                    found[self._name(spec, k)] = _text(v)
            return found
        if isinstance(item, list):
            if not spec.positional or any(isinstance(x, (dict, list)) for x in item):
                return None
            return {n: _text(x) for n, x in zip(spec.positional, item) if x is not None}
        if spec.positional:
            return {n: p.strip() for n, p in zip(spec.positional, _text(item).split(","))}
        return {"value": _text(item)}

    @staticmethod
    def _name(spec: Element, key: str) -> str:
        low = key.lower()  # "X" is "x" written by another vendor
        return low if low in spec.positional else key

    @staticmethod
    def _number(value: object, order: str | None, place: int) -> int:
        if order and isinstance(value, dict) and (stated := value.get(order)) is not None:
            try:
                return int(stated) if isinstance(stated, str) and stated.isdecimal() else int(float(stated))
            except (TypeError, ValueError, OverflowError):
                return place
        return place

    def _one(self, node: _Node, holds: Holds, item: object, place: int) -> None:
        spec = self.grammar.get(holds.element, self.fallback)
        if isinstance(item, dict) and not spec.items:
            for w in spec.wrappers:
                if w in item and (w not in spec.keys or item.keys() <= set(spec.wrappers)):
                    self.stack.append((1, node, holds, item[w]))
                    return
        self._element(node, holds.element, item, place)

    def _hold(self, node: _Node, element: str, n: int = 1) -> str:
        """Count children of a parent's instance; the home of the child."""
        home = element if element in self.at else node.home
        if self.graph and n:
            node.tally[element] += n
            edge = (home, node.element, element)
            self.held[edge] = max(self.held.get(edge, 0), node.tally[element])
        return home

    def _element(self, node: _Node, element: str, value: object, place: int) -> None:
        spec = self.grammar.get(element, self.fallback)
        number = place
        if spec.per_record:
            number = self.count[element]
            self.count[element] += 1
        number = self._number(value, spec.order, number)
        i = self.at.get(element)
        if i is None:
            parent, keys, extra = node.extra.get(element), node.keys, {**node.extra, element: number}
        else:
            parent, keys, extra = node.keys[i], (*node.keys[:i], number, *node.keys[i + 1 :]), node.extra
        own = _Node(element, self._hold(node, element), keys, extra, {})
        self._emit(element, keys, number, parent, own.attrs)
        self._content(own, value, "")

    def _content(self, node: _Node, value: object, prefix: str) -> None:
        element, attrs = node.element, node.attrs
        spec = self.grammar.get(element, self.fallback)
        if isinstance(value, dict):
            if spec.bare and any(k in value for k in spec.bare[0]):
                self._element(node, spec.bare[1], value, 0)
                return
            if spec.items and not prefix:  # a list's place: a wrapper object, or a bare item
                for w in spec.wrappers:
                    if w in value:
                        self.stack.append((0, node, value[w], prefix))
                        return
                if not spec.keys:
                    self._each(node, spec.items, value)
                    return
            later: list[tuple] = []
            for k, v in value.items():
                if k in spec.keys:
                    rule = spec.keys[k]
                    later.append((0, node, v, prefix) if rule is None else (1, node, rule, v))
                elif isinstance(v, dict):  # a singleton: inlined under a dotted name
                    later.append((0, node, v, f"{prefix}{k}."))
                elif isinstance(v, list):
                    later += [(3, node, f"{element}_{k}", x, i) for i, x in enumerate(v)]
                elif v is not None:
                    attrs[prefix + self._name(spec, k)] = _text(v)
            self.stack += reversed(later)
        elif isinstance(value, list):
            if spec.positional and all(not isinstance(x, (dict, list)) for x in value):
                attrs.update((n, _text(x)) for n, x in zip(spec.positional, value) if x is not None)
            elif spec.items:
                self._each(node, spec.items, value)
            else:
                self.stack += [(3, node, f"{element}_item", x, i) for i, x in reversed(list(enumerate(value)))]
        elif value is not None:
            if spec.positional:
                attrs.update(zip(spec.positional, (p.strip() for p in _text(value).split(","))))
            elif spec.items:
                self._each(node, spec.items, value)
            else:
                attrs[prefix + "value"] = _text(value)
        self._note(node)


def _text(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value)


def shred(df: DataFrame, grammar: Grammar, *, id_col: str, body_col: str, root: str, only: Sequence[str] | None = None, attributes: bool = True) -> DataFrame:
    """One row an element of each record: id, ``element``, ``<name>_no`` of the
    element and of each ancestor (null where there is none), ``place`` (its own
    number), ``parent_no`` (the nearest ancestor of the same element, for
    recursion) and ``attrs`` (plain values; those of inlined singletons under
    dotted names; left empty without ``attributes``).

    ``only`` limits the rows to some elements. A null body gives the root row
    alone; one that is no JSON too, with the attribute ``_invalid``. Null and
    missing keys are alike. Records may be nested to any depth. Repeated ids
    give repeated rows; other columns are ignored.
    """
    names, numbers = list(grammar), T.IntegerType()
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            T.StructField("element", T.StringType()),
            *[T.StructField(f"{n}_no", numbers) for n in names],
            T.StructField("place", numbers),
            T.StructField("parent_no", numbers),
            T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        ]
    )
    wanted = None if only is None else frozenset(only)
    maps = pa.map_(pa.string(), pa.string())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = _Walker(grammar, wanted, attributes)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                counts = [walker.record(body, root) for body in part.column(1).to_pylist()]
                n = len(walker.elements)
                ids = part.column(0).take(pa.array([i for i, c in enumerate(counts) for _ in range(c)], pa.int64()))
                attrs = pa.array([list(a.items()) for a in walker.attrs], maps) if attributes else pa.MapArray.from_arrays(pa.array([0] * (n + 1), pa.int32()), pa.array([], pa.string()), pa.array([], pa.string()))
                ints = [pa.array(c, pa.int32()) for c in (*walker.keys, walker.places, walker.parents)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(walker.elements, pa.string()), *ints, attrs], names=schema.names)
                walker.clear()

    return df.select(id_col, body_col).mapInArrow(run, schema)


def schema_graph(df: DataFrame, grammar: Grammar, *, body_col: str, root: str, max_edges: int = MAX_EDGES) -> list[dict]:
    """The graph of the records' elements, an edge a dict: parent ("" for the
    root), child, ``most`` (children of one parent instance, at most), ``kind``
    (element, attribute, or singleton for an object that a parent holds once)
    and ``home`` (the grammar's element that they belong to).

    Every record is read. Edges are combined in each task, so only names are
    shuffled. A home with more than ``max_edges`` edges below it is open: it is
    given as one edge of the kind "open" in place of them.
    """
    schema = "home string, parent string, child string, kind string, most long"
    fields = ("home", "parent", "child", "kind", "most")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = _Walker(grammar, graph=True)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                walker.record(body, root)
            edges = {(*e, "element"): n for e, n in walker.held.items()}
            for home, element, path in walker.paths:
                steps = [element, *path.split(".")]
                for i in range(1, len(steps)):
                    edges[home, steps[i - 1], steps[i], "singleton" if i < len(steps) - 1 else "attribute"] = 1
            walker.clear()
            columns = list(zip(*[(*e, n) for e, n in edges.items()])) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if f == "most" else pa.string()) for c, f in zip(columns, fields)], names=list(fields))

    key = ["home", "parent", "child", "kind"]
    edges = cut_lineage(df.select(body_col).mapInArrow(run, schema).groupBy(*key).agg(F.max("most").alias("most")))  # two jobs ask for it
    # A home's own place in its parent is kept; what lies below it is bounded by max_edges, or replaced.
    below = F.when((F.col("child") == F.col("home")) & (F.col("kind") == "element"), F.lit(False)).otherwise(F.lit(True))
    sizes = edges.groupBy("home").agg(F.count_if(below).alias("_n"))
    open_homes = [r["home"] for r in sizes.filter(F.col("_n") > max_edges).collect()]  # at most one for each element of the grammar
    closed = edges.filter(~below | ~F.col("home").isin(open_homes)).collect()  # at most max_edges for each
    return [r.asDict() for r in closed] + [{"home": h, "parent": h, "child": "*", "kind": "open", "most": 1} for h in open_homes]


def inline_plan(graph: Sequence[Mapping], keep: Sequence[str] = ()) -> dict[str, dict]:
    """element -> {"table": its own table or the element it is inlined into,
    "why": root, recursive, shared, repeated, kept or inlined, "kind", "parents",
    "columns": its attributes, "open": its keys are data}. Elements of ``keep``
    have a table even where all records hold one at most."""
    parents: dict[str, set[str]] = defaultdict(set)
    children: dict[str, set[str]] = defaultdict(set)
    most: dict[str, int] = defaultdict(int)
    columns: dict[str, set[str]] = defaultdict(set)
    kinds: dict[str, str] = {}
    opened: set[str] = set()
    for e in graph:
        if e["kind"] == "open":
            opened.add(e["parent"])
        elif e["kind"] == "attribute":
            columns[e["parent"]].add(e["child"])
        else:
            parents[e["child"]].add(e["parent"])
            children[e["parent"]].add(e["child"])
            most[e["child"]] = max(most[e["child"]], e["most"])
            kinds[e["child"]] = e["kind"]

    def reaches(start: str) -> set[str]:
        seen: set[str] = set()
        todo = [start]
        while todo:
            new = children[todo.pop()] - seen
            seen |= new
            todo += new
        return seen

    plan = {}
    for element, above in parents.items():
        if above == {""}:
            why = "root"
        elif element in reaches(element):
            why = "recursive"
        elif len(above) > 1:
            why = "shared"
        elif most[element] > 1:
            why = "repeated"
        elif element in keep or element in opened:
            why = "kept"
        else:
            why = "inlined"
        plan[element] = {"table": element if why != "inlined" else next(iter(above)), "why": why, "kind": kinds[element], "parents": sorted(above), "columns": sorted(columns[element]), "open": element in opened}
    return plan


def tables(rows: DataFrame, plan: Mapping[str, dict], grammar: Grammar, *, id_col: str, only: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """A DataFrame for each planned table (with ``only``, for some): id, own
    number ``<element>_no``, foreign keys (``<ancestor>_no``, and
    ``parent_<element>_no`` where an element can hold itself) and a column an
    attribute. Attributes of inlined singletons are prefixed columns; a shared
    singleton's table names its parent's element in ``parent_element``.

    An open element's attributes, and those of unknown elements below it, are
    rows of the table ``<element>_entries``: keys, element, place, path, value.
    ``rows`` is what ``shred`` gives, of the elements that the tables need.
    """
    keys = [f"{n}_no" for n in grammar]
    wanted = lambda name: only is None or name in only

    def paths(element: str, prefix: str) -> list[tuple[str, str]]:
        own = [(prefix + c, (prefix + c).replace(".", "_")) for c in plan[element]["columns"]]
        for e, p in plan.items():
            if p["kind"] == "singleton" and p["why"] == "inlined" and p["table"] == element:
                own += paths(e, f"{prefix}{e}.")
        return own

    def attributes(pairs: Sequence[tuple[str, str]]) -> list[Column]:
        return [F.col("attrs").getItem(path).alias(name) for path, name in pairs]

    out = {}
    for element, p in plan.items():
        if p["open"] and wanted(f"{element}_entries"):
            held = rows.filter((F.col("element") == element) | (F.col("element").startswith(f"{element}_") & ~F.col("element").isin(list(grammar))))
            out[f"{element}_entries"] = held.select(id_col, *keys, "element", "place", F.explode("attrs").alias("path", "value"))
        if not wanted(element):
            continue
        if p["kind"] == "singleton" and p["why"] != "inlined":
            pairs = [(path.removeprefix(f"{element}."), name) for path, name in paths(element, "")]
            parts = []
            for above in p["parents"]:
                held = rows.filter((F.col("element") == above) & F.exists(F.map_keys("attrs"), lambda k: k.startswith(f"{element}.")))
                parts.append(held.select(id_col, *keys, F.col("element").alias("parent_element"), *[F.col("attrs").getItem(f"{element}.{path}").alias(name) for path, name in pairs]))
            out[element] = reduce(DataFrame.unionByName, parts)
        elif p["kind"] == "element" and p["why"] != "inlined":
            own = rows.filter(F.col("element") == element)
            number = [] if f"{element}_no" in keys else [F.col("place").alias(f"{element}_no")]
            again = [F.col("parent_no").alias(f"parent_{element}_no")] if p["why"] == "recursive" else []
            out[element] = own.select(id_col, *number, *keys, *again, *attributes(paths(element, "")))
    for element, p in plan.items():
        if p["kind"] == "element" and p["why"] == "inlined" and p["table"] in out:
            on = [id_col, *[k for k in keys if k != f"{element}_no"]]
            part = rows.filter(F.col("element") == element).select(*[F.col(k).alias(f"_k_{k}") for k in on], *attributes([(path, f"{element}_{name}") for path, name in paths(element, "")]))
            into = out[p["table"]]
            match = reduce(Column.__and__, [into[k].eqNullSafe(part[f"_k_{k}"]) for k in on])
            out[p["table"]] = into.join(part, match, "left").drop(*[f"_k_{k}" for k in on])
    return out


_OBJECTS = {"Annotations": Holds("object"), "overlays": Holds("object"), "polygons": Holds("object")}
_GROUPS = {"AnnotationGroups": Holds("group"), "Group": Holds("group")}

#: Annotation sessions of three vendors.
SESSION_GRAMMAR: Grammar = {
    "session": Element(
        {"ASAP_Annotations": None, "session": None, "project": None, "image": Holds("image"), "images": Holds("image"), **_OBJECTS, **_GROUPS},
        items=Holds("object"),
        bare=(("points", "Coordinates", "point-list"), "object"),
    ),
    "image": Element({**_OBJECTS, **_GROUPS}, per_record=True),
    "group": Element({**_OBJECTS, **_GROUPS}, wrappers=("Group",), per_record=True),
    "object": Element(
        {"Coordinates": Holds("ring", many=False), "point-list": Holds("ring", many=False), "points": Holds("ring", many=False), "holes": Holds("ring", offset=1), "children": Holds("object"), **_OBJECTS},
        wrappers=("Annotation", "graphic"),
        per_record=True,
    ),
    "ring": Element({}, wrappers=("Coordinate", "point", "points"), items=Holds("vertex")),
    "vertex": Element({"point": None}, positional=("x", "y"), order="Order"),
}
