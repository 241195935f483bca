"""Feed entries to the `tenders` table, and tenders in the shape of notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.text import empty_to_null, leading_date, strip_or_null, to_number
from tenderloom.schemas import LEGAL, NOTICE_TYPE_OF_KIND, NOTICES, TECHNICAL, TENDER, TENDERS


def _first(elements: Column) -> Column:
    return F.get(elements, F.lit(0))


def _all_below(elements: Column, name: str) -> Column:
    """The `name` children of every element, in document order."""
    return F.flatten(F.array_compact(F.transform(elements, lambda element: element[name])))


def _text(elements: Column) -> Column:
    """Stripped text of the first element only; a blank first one is not passed over."""
    return strip_or_null(_first(elements)["_VALUE"])


def _documents(references: Column, kind: str) -> Column:
    listed = F.transform(
        references,
        lambda reference: F.struct(
            F.lit(kind).alias("kind"),
            _text(reference["ID"]).alias("name"),
            _text(reference["Attachment"]["ExternalReference"]["URI"]).alias("uri"),
        ),
    )
    with_uri = F.filter(listed, lambda document: document["uri"].isNotNull())
    return F.coalesce(with_uri, F.array().cast(TENDERS["documents"].dataType))


def parse_entries(entries: DataFrame) -> DataFrame:
    """Entries read with the `FEED_ENTRY` schema to tenders; other columns are carried along.

    Each value comes from its own parent block: an entry has several end dates, names and
    amounts. Where the tender as a whole has no such block, that of its first lot is used.
    """
    carried = [name for name in entries.columns if name not in ("id", "ContractFolderStatus")]
    status = F.col("ContractFolderStatus")
    # The tender's own project comes before those of its lots.
    no_projects = F.array().cast(entries.schema["ContractFolderStatus"].dataType["ProcurementProject"].dataType)
    projects = F.concat(
        F.coalesce(status["ProcurementProject"], no_projects),
        F.coalesce(_all_below(status["ProcurementProjectLot"], "ProcurementProject"), no_projects),
    )
    no_periods = F.array().cast(
        entries.schema["ContractFolderStatus"].dataType["TenderingProcess"].dataType.elementType[
            "TenderSubmissionDeadlinePeriod"
        ].dataType
    )
    lot_processes = _all_below(status["ProcurementProjectLot"], "TenderingProcess")
    deadline_periods = F.concat(
        F.coalesce(_all_below(status["TenderingProcess"], "TenderSubmissionDeadlinePeriod"), no_periods),
        F.coalesce(_all_below(lot_processes, "TenderSubmissionDeadlinePeriod"), no_periods),
    )
    scoped = entries.select(
        *carried,
        "id",
        status["ContractFolderID"].alias("folder"),
        projects.alias("projects"),
        deadline_periods.alias("periods"),
        status["LegalDocumentReference"].alias("legal"),
        status["TechnicalDocumentReference"].alias("technical"),
    )
    budget = _first(_all_below(F.col("projects"), "BudgetAmount"))
    commodities = _all_below(F.col("projects"), "RequiredCommodityClassification")
    # The estimate stands in for a blank amount, not for one that cannot be read.
    amount = F.coalesce(_text(budget["TaxExclusiveAmount"]), _text(budget["EstimatedOverallContractAmount"]))
    return scoped.select(
        *carried,
        F.coalesce(_text(F.col("id")), F.lit("")).alias("entry_id"),
        _text(F.col("folder")).alias("expediente"),
        _text(_first(F.col("projects"))["Name"]).alias("title"),
        to_number(amount).alias("budget"),
        _text(_all_below(commodities, "ItemClassificationCode")).alias("cpv_primary"),
        leading_date(_text(_first(F.col("periods"))["EndDate"])).alias("deadline"),
        F.concat(_documents(F.col("legal"), LEGAL), _documents(F.col("technical"), TECHNICAL)).alias("documents"),
    )


def _anywhere(*names: str) -> str:
    """Path to the first element of the last name, inside the first one of each name before; by local name, at any depth."""
    path = ""
    for name in names:
        path = f"({path}//*[local-name()='{name}'])[1]"
    return path


# No XML text can hold it, not even as a character reference.
_BETWEEN = "\uffff"


def _texts_anywhere(fragment: Column, *places: tuple[str, ...]) -> Column:
    """The text at each place, as a list; empty where there is none. One path for all, so one parse of the fragment."""
    path = f", '{_BETWEEN}', ".join(_anywhere(*names) for names in places)
    return F.split(F.xpath_string(fragment, F.lit(f"concat({path})")), _BETWEEN)


def _documents_anywhere(text: Column, element: str, kind: str) -> Column:
    # Cut out with their tags, whatever the prefix; a reference holds no other reference.
    block = rf"(?s)<((?:[\w.-]+:)?{element})(?:\s[^>]*)?>.*?</\1\s*>"
    references = F.transform(
        F.regexp_extract_all(text, F.lit(block), F.lit(0)),
        lambda reference: _texts_anywhere(reference, ("ID",), ("URI",)),
    )
    listed = F.transform(
        references,
        lambda texts: F.struct(
            F.lit(kind).alias("kind"),
            strip_or_null(F.get(texts, F.lit(0))).alias("name"),
            strip_or_null(F.get(texts, F.lit(1))).alias("uri"),
        ),
    )
    return F.filter(listed, lambda document: document["uri"].isNotNull())


def _references_anywhere(entry: Column) -> Column:
    uncommented = F.array(F.regexp_replace(entry, r"(?s)<!--.*?-->", ""))
    return F.transform(
        uncommented,
        lambda text: F.concat(
            _documents_anywhere(text, "LegalDocumentReference", LEGAL),
            _documents_anywhere(text, "TechnicalDocumentReference", TECHNICAL),
        ),
    )[0]


_PLACES = (
    ("id",),
    ("ContractFolderID",),
    ("ProcurementProject", "Name"),
    ("BudgetAmount", "TaxExclusiveAmount"),
    ("BudgetAmount", "EstimatedOverallContractAmount"),
    ("ItemClassificationCode",),
    ("TenderSubmissionDeadlinePeriod", "EndDate"),
)
_ANYWHERE = "__anywhere"


def _with_anywhere(entries: DataFrame, texts: Column, documents: Column) -> DataFrame:
    """`entries` with what was found in them at any depth. Through a generator, so that it is looked for once."""
    return entries.select("*", F.inline(F.array(F.struct(F.struct(texts.alias("texts"), documents.alias("documents")).alias(_ANYWHERE)))))


def _found_anywhere() -> dict[str, Column]:
    def text(place: int) -> Column:
        return strip_or_null(F.get(F.col(f"{_ANYWHERE}.texts"), F.lit(place)))

    return {
        "entry_id": F.coalesce(text(0), F.lit("")),
        "expediente": text(1),
        "title": text(2),
        "budget": to_number(F.coalesce(text(3), text(4))),
        "cpv_primary": text(5),
        "deadline": leading_date(text(6)),
        "documents": F.coalesce(f"{_ANYWHERE}.documents", F.array().cast(TENDERS["documents"].dataType)),
    }


def parse_entries_anywhere(entries: DataFrame, text: str = "entry") -> DataFrame:
    """As `parse_entries`, from entries held as text, and at any depth: each value is that of the first element of its
    name, inside the first block of its parent's name, wherever these are. Other columns are carried along.

    An entry is parsed once for its values and each of its references once more.
    """
    entry, found = F.col(f"`{text}`"), _found_anywhere()
    carried = [name for name in entries.columns if name != text and name not in found]
    looked = _with_anywhere(entries, _texts_anywhere(entry, *_PLACES), _references_anywhere(entry))
    return looked.select(*carried, *[value.alias(name) for name, value in found.items()])


def complete_entries(parsed: DataFrame, text: str = "entry") -> DataFrame:
    """Entries parsed at their declared paths, with their text carried along, and what those paths did not find looked for
    at any depth. The text is dropped."""

    entry, found = F.col(f"`{text}`"), _found_anywhere()

    def empty(name: str) -> Column:
        return F.size(name) == 0 if name == "documents" else F.coalesce(F.col(name).cast("string"), F.lit("")) == ""

    def completed(name: str, anywhere: Column) -> Column:
        return F.when(empty(name), anywhere).otherwise(F.col(name)).alias(name)

    any_empty = F.array_contains(F.array(*[empty(name) for name in found if name != "documents"]), True)
    looked = _with_anywhere(
        parsed,
        F.when(any_empty, _texts_anywhere(entry, *_PLACES)),
        F.when(empty("documents"), _references_anywhere(entry)),
    )
    carried = [name for name in parsed.columns if name != text and name not in found]
    return looked.select(*carried, *[completed(name, value) for name, value in found.items()])


def legal_documents(documents: Column) -> Column:
    """The administrative specifications among a tender's documents."""
    return F.filter(documents, lambda document: document["kind"] == LEGAL)


def zip_documents(kinds: Column, names: Column, uris: Column) -> Column:
    """Documents from three parallel lists, to the length of the shortest; an empty name is NULL."""
    length = F.least(F.size(kinds), F.size(names), F.size(uris))
    zipped = F.arrays_zip(
        F.slice(kinds, 1, length).alias("kind"),
        F.slice(names, 1, length).alias("name"),
        F.slice(uris, 1, length).alias("uri"),
    )
    documents = F.transform(
        zipped,
        lambda row: F.struct(row["kind"].alias("kind"), empty_to_null(row["name"]).alias("name"), row["uri"].alias("uri")),
    )
    return F.coalesce(documents, F.array().cast(TENDERS["documents"].dataType))


def notice_key() -> Column:
    """What a tender is called among notices: its id, else its file number."""
    return F.coalesce(empty_to_null(F.col("entry_id")), empty_to_null(F.col("expediente")), F.lit("unknown"))


def as_notices(tenders: DataFrame) -> DataFrame:
    """Tenders with the columns of `notices`, so both can be searched and graded together."""
    no_texts = F.array().cast("array<string>")
    has_code = F.length("cpv_primary") > 0
    shaped = tenders.select(
        notice_key().alias("publication_number"),
        F.lit(NOTICE_TYPE_OF_KIND[TENDER]).alias("notice_type"),
        F.lit(TENDER).alias("kind"),
        F.lit(None).cast("string").alias("procedure_id"),
        F.lit(False).alias("is_eforms"),
        F.when(has_code, F.array("cpv_primary")).otherwise(no_texts).alias("cpv"),
        "cpv_primary",
        F.lit(None).cast("string").alias("buyer_name"),
        "title",
        F.lit(None).cast("date").alias("publication_date"),
        "deadline",
        F.col("budget").alias("estimated_value"),
        no_texts.alias("winner_names"),
        no_texts.alias("winner_selection_status"),
        F.lit(None).cast("string").alias("award_outcome"),
        F.array().cast("array<double>").alias("tender_values"),
        F.lit(None).cast("double").alias("result_value"),
    )
    return shaped.select(*NOTICES.names)


def all_opportunities(notices: DataFrame, tenders: DataFrame) -> DataFrame:
    """Tender notices and feed tenders in one table."""
    return notices.where(F.col("kind") == TENDER).select(*NOTICES.names).unionByName(as_notices(tenders))
