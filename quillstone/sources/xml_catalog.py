"""Classification scheme and definition XML as a Spark data source.

Entries nest in entries of the same name and titles mix text with markup, which Spark's row-tag reader can't take
apart; each file is one partition, streamed and freed element by element.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Element names of the definition files.
REFERENCE_BLOCKS = ("LIMITINGREFERENCES", "APPLICATIONORIENTEDREFERENCES", "INFORMATIVEREFERENCES", "REFERENCESOUTOFARESIDUALPLACE")
KEYWORD_BLOCKS = {"ABBREVIATIONS": "abbreviations", "INSTEADOFWORDS": "instead_of_words", "SPECIALMEANINGS": "special_meanings"}

_REFERENCES = "map<string,array<struct<text:string,symbols:array<string>>>>"
_PAIRS = "array<struct<term:string,definition:string>>"
SCHEME = "ord long, symbol string, kind string, entry_type string, edition string, end_symbol string, title string, note string"
DEFINITIONS = (
    f"ord long, symbol string, definition_statement string, references {_REFERENCES}, glossary array<struct<terms:array<string>,definition:string>>, large_subjects string, "
    f"synonyms_and_keywords struct<synonyms:array<array<string>>,abbreviations:{_PAIRS},instead_of_words:{_PAIRS},special_meanings:{_PAIRS},other:map<string,string>>, special_rules string, extra map<string,string>"
)


def name_of(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def flat(e: ET.Element | None) -> str | None:
    """All text of an element with single blanks; null where there is none."""
    return None if e is None else " ".join("".join(e.itertext()).split()) or None


def children(e: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in e if name_of(c) == name]


def within(e: ET.Element, name: str) -> Iterator[ET.Element]:
    return (c for c in e.iter() if name_of(c) == name)


def links(e: ET.Element) -> list[str]:
    """Distinct targets of the links in an element, in order."""
    return list(dict.fromkeys(h for a in within(e, "a") if (h := (a.get("href") or "").strip())))


def reference_rows(block: ET.Element) -> list[dict]:
    rows = []
    for tr in within(block, "tr"):
        cells = children(tr, "td")
        if cells:
            row = {"text": flat(cells[0]) or "", "symbols": links(cells[1]) if len(cells) > 1 else []}
            if row["text"] or row["symbols"]:
                rows.append(row)
    return rows


def definition_list(block: ET.Element) -> Iterator[tuple[list[str], bool, str | None]]:
    """(terms since the last definition, whether there were dt elements, definition) for each dd."""
    for dl in within(block, "dl"):
        terms: list[str | None] = []
        for item in dl:
            if name_of(item) == "dt":
                terms.append(flat(item))
            elif name_of(item) == "dd":
                yield [t for t in terms if t], terms[-1] if terms else None, flat(item)
                terms = []


def keywords(block: ET.Element) -> dict | None:
    out: dict = {}
    for c in block:
        n = name_of(c)
        if n == "SYNONYMS":
            groups = [g for ul in within(c, "ul") if (g := [t for li in children(ul, "li") if (t := flat(li))])]
            if groups:
                out["synonyms"] = groups
        elif n in KEYWORD_BLOCKS:
            pairs = [{"term": last, "definition": d} for _, last, d in definition_list(c)]
            if pairs:
                out[KEYWORD_BLOCKS[n]] = pairs
        elif t := flat(c):
            out.setdefault("other", {})[n.lower()] = t
    return out or None


def definition(e: ET.Element) -> dict:
    out: dict = {"extra": {}}
    for c in e:
        n = name_of(c)
        if n == "REFERENCES":
            refs = {name_of(b).lower(): rows for b in c if name_of(b) in REFERENCE_BLOCKS and (rows := reference_rows(b))}
            out["references"] = refs or None
        elif n == "GLOSSARYOFTERMS":
            out["glossary"] = [{"terms": terms, "definition": d} for terms, _, d in definition_list(c) if terms or d] or None
        elif n == "SYNONYMSANDKEYWORDS":
            out["synonyms_and_keywords"] = keywords(c)
        elif n in ("DEFINITION-STATEMENT", "LARGESUBJECTS", "SPECIALRULES"):
            out[{"DEFINITION-STATEMENT": "definition_statement", "LARGESUBJECTS": "large_subjects", "SPECIALRULES": "special_rules"}[n]] = flat(c)
        elif t := flat(c):
            out["extra"][n.lower()] = t
    return out


def title_of(body: ET.Element) -> str | None:
    for t in children(body, "title")[:1]:
        parts = [" ".join(x for el in children(p, "text") if (x := flat(el))) for p in children(t, "titlePart")]
        return "; ".join(p for p in parts if p) or None
    return None


def note_of(body: ET.Element) -> str | None:
    return " ".join(x for n in children(body, "note") if (x := flat(n))) or None


def entries(path: str, wanted: str) -> Iterator[tuple[str, ET.Element]]:
    """(symbol, element) at each end of ``wanted``, children before parents; elements are freed as they go."""
    attribute = "IPC" if wanted == "IPC-DEFINITION" else "symbol"
    for _, e in ET.iterparse(path, events=("end",)):
        if name_of(e) == wanted:
            symbol = (e.get(attribute) or "").strip()
            if symbol:
                yield symbol, e
            for c in e:
                c.clear()
            e.clear()


class CatalogSource(DataSource):
    """``format("ipc_xml")`` with option ``part``: scheme or definitions. Option ``paths``: JSON list of files."""

    @classmethod
    def name(cls) -> str:
        return "ipc_xml"

    def schema(self) -> str:
        return SCHEME if self.options.get("part", "scheme") == "scheme" else DEFINITIONS

    def reader(self, schema) -> DataSourceReader:
        return CatalogReader(self.options.get("part", "scheme"), json.loads(self.options["paths"]))


class CatalogReader(DataSourceReader):
    def __init__(self, part: str, paths: list[str]) -> None:
        self.part, self.paths = part, paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((i, p)) for i, p in enumerate(self.paths)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        file, path = partition.value
        path = re.sub(r"^file:(//)?", "", path)
        base = file << 40
        if self.part == "scheme":
            for i, (symbol, e) in enumerate(entries(path, "ipcEntry")):
                body = next(iter(children(e, "textBody")), None)
                yield base + i, symbol, e.get("kind") or "", e.get("entryType"), e.get("edition"), e.get("endSymbol"), None if body is None else title_of(body), None if body is None else note_of(body)
            return
        for i, (symbol, e) in enumerate(entries(path, "IPC-DEFINITION")):
            d = definition(e)
            k = d.get("synonyms_and_keywords")
            pairs = lambda n: [(x["term"], x["definition"]) for x in k[n]] if k.get(n) else None  # noqa: B023, E731
            refs = d.get("references")
            yield (
                base + i, symbol, d.get("definition_statement"), {n: [(r["text"], r["symbols"]) for r in rows] for n, rows in refs.items()} if refs else None,
                [(g["terms"], g["definition"]) for g in d["glossary"]] if d.get("glossary") else None, d.get("large_subjects"),
                (k.get("synonyms"), pairs("abbreviations"), pairs("instead_of_words"), pairs("special_meanings"), k.get("other")) if k else None, d.get("special_rules"), d["extra"] or None,
            )


def read_catalog_xml(spark: SparkSession, paths: list[str], part: str) -> DataFrame:
    spark.dataSource.register(CatalogSource)
    return spark.read.format("ipc_xml").option("part", part).option("paths", json.dumps(paths)).load()


def latest_definitions(definitions: DataFrame) -> DataFrame:
    """One row a symbol: the last in file order."""
    return definitions.groupBy("symbol").agg(F.max_by(F.struct("*"), "ord").alias("d")).select("d.*").drop("ord")
