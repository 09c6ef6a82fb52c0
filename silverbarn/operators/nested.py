"""Nested records as flat node tables linked by interval containment.

``label_nodes`` walks every JSON document depth first and gives each node a
pre-order and a post-order number: node A encloses node B exactly if
A.pre < B.pre and B.post < A.post. The tables per type are selections of
nodes by tag; a child finds its parent by containment, with no key copied
into it during the walk. A tree lies in one record, so ``enclosing`` links the
nodes of a record where it is walked, without a shuffle; ``link`` does the same
for node tables that were stored.

Tags are key paths (``filings.recent.form``). The elements of a list carry the
list's own path and their place; the list node itself has ``[]`` appended. A
single value that stands for a list therefore has the same tag as a list
element, at place 0.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NODE_SCHEMA = "tree string, tag string, kind string, pre bigint, post bigint, pos bigint, value string"


def walk(document: str) -> list[tuple[str, str, int, int, int, str | None]] | None:
    """(tag, kind, pre, post, pos, value) of every node in pre-order; None if the text is no JSON object.

    Iterative, so depth is limited only by the parser; a text the parser
    rejects, for depth as for syntax, is unreadable. A document that is a JSON
    text holding a document is read through, however often it is wrapped.
    """
    root = document
    try:
        while isinstance(root, str):
            root = json.loads(root)
    except (ValueError, TypeError, RecursionError):
        return None
    if not isinstance(root, dict):
        return None
    nodes: list[list] = []
    pre = post = 0
    stack: list[tuple] = [("", 0, root, -1)]
    while stack:
        tag, pos, item, done = stack.pop()
        if done >= 0:
            nodes[done][3] = post
            post += 1
            continue
        at, pre = pre, pre + 1
        if isinstance(item, dict):
            nodes.append([tag, "object", at, 0, pos, None])
            stack.append((tag, pos, None, at))
            base = f"{tag}." if tag else ""
            stack += [(base + key, 0, sub, -1) for key, sub in reversed(item.items())]
        elif isinstance(item, list):
            nodes.append([tag + "[]", "list", at, 0, pos, None])
            stack.append((tag, pos, None, at))
            # a list within a list gets a level of its own
            stack += [(tag + "[]" if isinstance(item[i], list) else tag, i, item[i], -1) for i in range(len(item) - 1, -1, -1)]
        else:
            kind = "null" if item is None else "text" if isinstance(item, str) else "other"
            shown = None if item is None else item if isinstance(item, str) else json.dumps(item)
            nodes.append([tag, kind, at, post, pos, shown])
            post += 1
    return nodes


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["tree", "tag", "kind", "pre", "post", "pos", "value"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        cols: list[list] = [[] for _ in names]
        for tree, document in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            nodes = walk(document) if document is not None else None
            if nodes:
                cols[0] += [tree] * len(nodes)
                for col, part in zip(cols[1:], zip(*nodes)):
                    col += part
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def label_nodes(documents: DataFrame, tree: str, text: str) -> DataFrame:
    """All nodes of all readable documents.

    Null, empty, damaged and non-object texts give no nodes. ``tree`` must be
    unique; equal trees would share intervals. Extra columns are ignored.
    """
    return documents.select(F.col(tree).alias("tree"), F.col(text).alias("text")).mapInArrow(_label, NODE_SCHEMA)


def nodes_of(nodes: DataFrame, tag: str, *kinds: str) -> DataFrame:
    """The node table of one type."""
    own = nodes.where(F.col("tag") == tag)
    return own.where(F.col("kind").isin(*kinds)) if kinds else own


def link(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Children with their nearest enclosing parent by interval containment.

    Adds ``parent_pre``, ``parent_pos`` and ``parent_value``. One pass in
    pre-order per tree: types that do not nest in themselves have at most one
    candidate, the last parent opened before the child, which must not have
    been closed yet. Children outside any parent are left out.
    """
    marked = parents.select("*", F.lit(True).alias("_is_parent")).unionByName(children.select("*", F.lit(False).alias("_is_parent")))
    opened = F.last(F.when(F.col("_is_parent"), F.struct("pre", "post", "pos", "value")), ignorenulls=True).over(
        W.partitionBy("tree").orderBy("pre", F.col("_is_parent").desc()).rowsBetween(W.unboundedPreceding, 0)
    )
    return (
        marked.withColumn("_p", opened)
        .where(~F.col("_is_parent") & (F.col("_p.pre") < F.col("pre")) & (F.col("post") < F.col("_p.post")))
        .select(*parents.columns, F.col("_p.pre").alias("parent_pre"), F.col("_p.pos").alias("parent_pos"), F.col("_p.value").alias("parent_value"))
    )


Node = tuple[str, str, int, int, int, str | None]
Child = tuple[str, str | None, int, str]
_PRE, _POST, _POS, _VALUE = 2, 3, 4, 5


class NodeTables:
    """The nodes of one record by tag, each table in pre-order."""

    def __init__(self, nodes: list[Node]):
        self.by_tag: dict[str, list[Node]] = {}
        for node in nodes:
            self.by_tag.setdefault(node[0], []).append(node)

    def of(self, tag: str, *kinds: str) -> list[Node]:
        return [n for n in self.by_tag.get(tag, ()) if n[1] in kinds]


def enclosing(parents: list[Node], children: list[Node]) -> Iterator[tuple[Node, Node]]:
    """(parent, child) of every child whose interval lies within a parent's.

    ``parents`` is in pre-order and of a type that does not nest in itself, so
    the only candidate is the last one opened before the child.
    """
    opened = [p[_PRE] for p in parents]
    for child in children:
        k = bisect_left(opened, child[_PRE]) - 1
        if k >= 0 and child[_POST] < parents[k][_POST]:
            yield parents[k], child


def plain_accession(accession: Column) -> Column:
    return F.regexp_replace(accession, "-", "")


def _named(t: NodeTables, kind: str, tag: str) -> list[Child]:
    """Objects of a tag with the text of their member ``name``."""
    return [(kind, None, p[_POS], c[_VALUE]) for p, c in enclosing(t.of(tag, "object"), t.of(f"{tag}.name", "text"))]


_PLACES = tuple(f"filings.recent.{m}" for m in ("accessionNumber", "form", "filingDate"))


def _filings(t: NodeTables) -> list[Child]:
    rows = t.of("filings.recent", "object")
    # in a list of objects the place is that of the enclosing object, in parallel lists it is the value's own
    in_list = bool(t.by_tag.get("filings.recent[]"))
    found: list[dict[int, str | None]] = []
    for tag in _PLACES:
        linked = enclosing(rows, t.of(tag, "text", "other", "null"))
        found.append({(p[_POS] if in_list else c[_POS]): c[_VALUE] for p, c in linked})
    accessions, forms, days = found
    first: dict[str, int] = {}
    for place in sorted(accessions.keys() & forms.keys() & days.keys()):
        plain = (accessions[place] or "").replace("-", "")
        if accessions[place]:
            first.setdefault(plain, place)
    return [("filing", None, place, plain) for plain, place in first.items()]


def submission_tables(document: str) -> list[Child] | None:
    """(kind, None, place, key) of the tickers, former names, filing pages and filings of a payload; None if unreadable."""
    nodes = walk(document)
    if nodes is None:
        return None
    t = NodeTables(nodes)
    tickers = [("ticker", None, n[_POS], n[_VALUE]) for n in t.of("tickers", "text", "other")]
    return tickers + _named(t, "former_name", "formerNames") + _named(t, "page", "filings.files") + _filings(t)


def file_tables(document: str) -> list[Child] | None:
    """(kind, name of the file for a member, place, key) of the files and archive members of an index entry."""
    nodes = walk(document)
    if nodes is None:
        return None
    t = NodeTables(nodes)
    files = list(enclosing(t.of("files", "object"), t.of("files.name", "text")))
    name = {p[_PRE]: c[_VALUE] for p, c in files}
    members = list(enclosing(t.of("files.members", "object"), t.of("files.members.name", "text")))
    owner = {c[_PRE]: p[_PRE] for p, c in enclosing([p for p, _ in files], [c for _, c in members])}
    out: list[Child] = [("file", None, p[_POS], c[_VALUE]) for p, c in files]
    return out + [("member", name[owner[c[_PRE]]], p[_POS], c[_VALUE]) for p, c in members if c[_PRE] in owner]


_CHILD = "struct<kind:string,owner:string,pos:bigint,child_key:string>"
_CHILDREN = pa.list_(pa.struct([("kind", pa.string()), ("owner", pa.string()), ("pos", pa.int64()), ("child_key", pa.string())]))


def _tables(make: Callable[[str], list[Child] | None]) -> Callable:
    """Batches with the children of the last column instead of its text; unreadable records go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(text) for text in batch.columns[-1].to_pylist()]
            keep = pa.array([m is not None for m in made], pa.bool_())
            kept = batch.filter(keep)
            rows = [[dict(zip(("kind", "owner", "pos", "child_key"), c)) for c in m] for m in made if m is not None]
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(rows, _CHILDREN)], [*kept.schema.names[:-1], "children"])

    return run


def submission_children(submissions: DataFrame) -> DataFrame:
    """Tickers, former names, filing pages and filings of the latest readable payload of every cik.

    Rows (kind, parent_key, pos, child_key). Null ciks are left out; null
    tickers and names are no children. A filing exists at every place that
    accessionNumber, form and filingDate all reach, in parallel lists, in a
    list of objects and as single values; of places with one accession the
    first counts. Of payloads fetched in one microsecond the greater text
    counts. One shuffle by cik, after all but the latest payload of a task
    have been dropped.
    """
    rows = submissions.where(F.col("cik").isNotNull() & F.col("payload").isNotNull())
    rows = rows.select("cik", F.coalesce(F.unix_micros(F.col("fetched_at").cast("timestamp")), F.lit(-(2**63))).alias("at"), F.sha2("payload", 256).alias("h"), "payload")
    walked = rows.mapInArrow(_tables(submission_tables), f"cik string, at bigint, h string, children array<{_CHILD}>")
    latest = walked.groupBy("cik").agg(F.max_by("children", F.struct("at", "h")).alias("children"))
    return latest.select("cik", F.inline("children")).select("kind", F.col("cik").alias("parent_key"), "pos", "child_key")


def accession_children(index: DataFrame) -> DataFrame:
    """Files of every accession and archive members of every file, as distinct (kind, parent_key, pos, child_key).

    Null and empty lists give no rows, a null accession or file name none
    either; entries are walked where they lie.
    """
    rows = index.where(F.col("accession").isNotNull() & F.col("files").isNotNull()).select(plain_accession(F.col("accession")).alias("parent"), F.to_json(F.struct("files")).alias("text"))
    walked = rows.mapInArrow(_tables(file_tables), f"parent string, children array<{_CHILD}>")
    parts = walked.select("parent", F.inline("children"))
    return parts.select("kind", F.concat_ws("/", "parent", "owner").alias("parent_key"), "pos", "child_key").distinct()


def nested_tables(submissions: DataFrame, index: DataFrame) -> DataFrame:
    """Every child of both sources with its parent and place, distinct; kinds and keys of the two never meet."""
    return submission_children(submissions).distinct().unionByName(accession_children(index))


_RECENT = "filings struct<recent struct<accessionNumber array<string>, form array<string>, filingDate array<string>, reportDate array<string>, primaryDocument array<string>>>"


def filing_rows(submissions: DataFrame, strict: bool = False) -> DataFrame:
    """(cik, accession, form, filing_date, report_date, document) of payloads whose recent filings are parallel lists.

    The lists are cut to the shortest of accession, form and date; report date
    and document may be absent. Of one accession of a cik the first row counts,
    the latest payload first. A filing date that cannot be read is an error
    with ``strict``, else the row is dropped.
    """
    rows = submissions.where(F.col("cik").isNotNull()).select("cik", "fetched_at", F.from_json("payload", _RECENT)["filings"]["recent"].alias("r"))
    n = F.least(F.size("r.accessionNumber"), F.size("r.form"), F.size("r.filingDate"))
    item = lambda i: F.struct(*[F.get(F.col(f"r.{m}"), i).alias(m) for m in ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument")])
    each = rows.where(n > 0).select("cik", "fetched_at", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), item)).alias("pos", "f")).select("cik", "fetched_at", "pos", "f.*")
    day = F.try_to_date("filingDate", "yyyy-MM-dd")
    if strict:
        day = F.when(day.isNull(), F.raise_error(F.concat(F.lit("unreadable filing date: "), F.coalesce("filingDate", F.lit("null"))))).otherwise(day)
    named = each.where(F.coalesce("accessionNumber", F.lit("")) != "").select(
        "cik", plain_accession(F.col("accessionNumber")).alias("accession"), "form", day.alias("filing_date"), F.try_to_date("reportDate", "yyyy-MM-dd").alias("report_date"),
        F.nullif(F.col("primaryDocument"), F.lit("")).alias("document"), F.struct((-F.unix_micros(F.col("fetched_at").cast("timestamp"))).alias("a"), "pos").alias("_order"),
    )
    kept = named.where(F.col("filing_date").isNotNull())
    first = kept.groupBy("cik", "accession").agg(F.min_by(F.struct("form", "filing_date", "report_date", "document"), "_order").alias("f"))
    return first.select("cik", "accession", "f.*")
