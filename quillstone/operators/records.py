"""Raw enrichment records to clean ones, and their primary documents, texts and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import first_claim, is_blank, join_claims, let, parse_claims, present, strip
from quillstone.sources.jsonl import field

#: What a document type is worth as the primary document; any other type is worth 0.
TYPE_RANK = {"B9": 60, "B2": 50, "B1": 40, "C1": 30, "A2": 20, "A1": 10}


def _array(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _is(v: Column, path: str, kind: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant")) == kind


def _text_only(v: Column, path: str) -> Column:
    """A member that is a string, else empty."""
    return F.when(_is(v, path, "STRING"), F.try_variant_get(v, path, "string")).otherwise("")


def sequence_number(v: Column, path: str) -> Column:
    """An integer, an integral decimal or a text of digits; else null (booleans too)."""
    x = F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(x)
    number = F.try_variant_get(v, path, "double")
    text = strip(F.try_variant_get(v, path, "string"))
    return (
        F.when(kind == "BIGINT", F.try_variant_get(v, path, "long"))
        .when((kind == "DOUBLE") | kind.startswith("DECIMAL"), F.when(number == F.floor(number), number.try_cast("long")))
        .when((kind == "STRING") & text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))
    )


def names(v: Column, path: str) -> Column:
    """legalEntityName of the objects of a list, trimmed, blanks left out."""
    found = F.transform(F.filter(_array(v, path), _is_object), lambda x: strip(_text_only(x, "$.legalEntityName")))
    return F.filter(found, lambda n: n != "")


def codes(v: Column, path: str) -> tuple[Column, Column]:
    """(codes in order, primary code): the primary has the smallest sequence number, the first of equals; else the first code."""
    rows = F.filter(
        F.transform(F.filter(_array(v, path), _is_object), lambda x: F.struct(strip(_text_only(x, "$.classificationText")).alias("code"), sequence_number(x, "$.sequenceNumber").alias("seq"))),
        lambda r: r["code"] != "",
    )
    order = F.array_min(F.filter(F.transform(rows, lambda r, i: F.struct(r["seq"].alias("s"), i.alias("i"), r["code"].alias("c"))), lambda r: r["s"].isNotNull()))
    all_codes = F.transform(rows, lambda r: r["code"])
    return all_codes, F.coalesce(order["c"], F.get(all_codes, F.lit(0)), F.lit(""))


def document(v: Column) -> Column:
    return let(
        parse_claims(_text_only(v, "$.claimsText")),
        lambda parsed: F.struct(
            field(v, "$.documentTypeCode").alias("document_type_code"),
            field(v, "$.fileName").alias("file_name"),
            strip(_text_only(v, "$.abstractText")).alias("abstract"),
            parsed["claims"].alias("claims"),
            parsed["ok"].alias("claims_parse_ok"),
        ),
    )


def clean_records(raw: DataFrame, response: str = "response", application: str = "application_number") -> DataFrame:
    """Clean records of raw lines (application number, fetched_at, response as JSON text).

    The number comes from the line, else from the response; missing members are empty texts or lists, items that are
    no objects are left out, scalars of another type are kept as text.  A response that is no JSON object gives an
    otherwise empty record.  One pass without a shuffle.
    """
    b = "$.bibliographicData"
    v = F.col("_v")
    all_codes, primary = codes(v, f"{b}.ipcrClassification")
    own = strip(present(F.col(application)))
    titles = F.filter(F.transform(F.filter(_array(v, f"{b}.inventionTitle"), _is_object), lambda x: strip(_text_only(x, "$.title"))), lambda t: t != "")
    parsed = raw.withColumn("_v", F.try_parse_json(F.col(response)))
    parsed = parsed.withColumn("_v", F.when(F.schema_of_variant("_v").startswith("OBJECT"), F.col("_v")))
    keep = [c for c in raw.columns if c in ("rec_id", "shard", "line_no", "file", "line", "phase")]
    return parsed.select(
        *keep,
        F.when(own == "", strip(field(v, f"{b}.applicationNumber"))).otherwise(own).alias("application_number"),
        present(F.col("fetched_at")).alias("fetched_at"),
        field(v, "$.ipRightStatusCode").alias("ip_right_status_code"),
        present(F.get(titles, F.lit(0))).alias("invention_title"),
        primary.alias("primary_ipc"),
        all_codes.alias("ipcr_classification"),
        field(v, f"{b}.patentApplicationType").alias("patent_application_type"),
        field(v, "$.filedDate").alias("filed_date"),
        field(v, "$.priorityDate").alias("priority_date"),
        field(v, "$.expiryDate").alias("expiry_date"),
        names(v, "$.applicant").alias("applicant"),
        names(v, "$.inventors").alias("inventors"),
        F.transform(F.filter(_array(v, "$.publishedDocuments"), _is_object), document).alias("published_documents"),
    )


def clean_summary(clean: DataFrame) -> DataFrame:
    """Counters of a cleaning run in one row: records, written, skipped (no number), documents with claims parsed or not."""
    skipped = F.col("application_number") == ""
    docs = F.coalesce("published_documents", F.array().cast(clean.schema["published_documents"].dataType))
    count = lambda f: F.coalesce(F.sum(F.when(~skipped, F.size(F.filter(docs, f))).cast("long")), F.lit(0))
    return clean.agg(
        F.count("*").alias("records_in"),
        F.count_if(~skipped).alias("records_written"),
        F.count_if(skipped).alias("records_skipped"),
        count(lambda d: F.lit(True)).alias("documents"),
        count(lambda d: F.coalesce(d["claims_parse_ok"], F.lit(False))).alias("claims_ok"),
        count(lambda d: ~F.coalesce(d["claims_parse_ok"], F.lit(True))).alias("claims_failed"),
    )


def type_rank(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TYPE_RANK.items() for x in kv])
    return F.coalesce(table[F.upper(strip(present(code)))], F.lit(0))


def primary_document(docs: Column) -> Column:
    """The document of highest type rank, then most claims, then longest abstract; the first of equals; null without any.

    An argmax over the array: no explode, no shuffle.
    """
    scored = F.transform(
        F.filter(docs, lambda d: d.isNotNull()),
        lambda d, i: F.struct(type_rank(d["document_type_code"]).alias("rank"), F.coalesce(F.size(d["claims"]), F.lit(0)).alias("n"), F.length(strip(present(d["abstract"]))).alias("chars"), (-i).alias("first"), d.alias("doc")),
    )
    return F.array_max(scored)["doc"]


def primary_texts(clean: DataFrame) -> DataFrame:
    """Records with their primary document as ``doc`` (null where there is none)."""
    return clean.withColumn("doc", primary_document(F.col("published_documents")))


def patent_texts(clean: DataFrame) -> DataFrame:
    """Text projection of usable records: number, primary document, its claims not known to be badly parsed, abstract and claims."""
    t = primary_texts(clean).filter("doc IS NOT NULL")
    texts = t.select(
        strip(F.col("application_number")).alias("application_number"),
        present(F.col("invention_title")).alias("invention_title"),
        present(F.col("primary_ipc")).alias("primary_ipc"),
        strip(present(F.col("doc.abstract"))).alias("abstract"),
        join_claims(F.col("doc.claims")).alias("claims_text"),
        first_claim(F.col("doc.claims")).alias("claim_1"),
        present(F.col("doc.document_type_code")).alias("document_type"),
        F.coalesce("doc.claims_parse_ok", F.lit(True)).alias("ok"),
        *[c for c in ("rec_id",) if c in clean.columns],
    )
    return texts.filter("ok AND application_number <> '' AND abstract <> '' AND claims_text <> ''").drop("ok")


def text_exports(clean: DataFrame) -> dict[str, DataFrame]:
    """The three text tables: abstracts, first claims (one row a record, also without document) and claims (one row a claim)."""
    t = primary_texts(clean.filter(~is_blank(F.col("application_number")))).withColumns({"application_number": strip(F.col("application_number")), "invention_title": strip(present(F.col("invention_title")))})
    claims = t.select("application_number", "invention_title", F.posexplode("doc.claims").alias("pos", "claim"))
    return {
        "abstracts": t.select("application_number", "invention_title", strip(present(F.col("doc.abstract"))).alias("abstract")),
        "first_claims": t.select("application_number", "invention_title", first_claim(F.col("doc.claims")).alias("claim")),
        "claims": claims.filter(~is_blank(F.col("claim"))).select("application_number", "invention_title", (F.col("pos") + 1).cast("long").alias("claim_no"), strip(F.col("claim")).alias("claim")),
    }
