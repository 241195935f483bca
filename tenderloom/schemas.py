"""Table schemas and the closed vocabularies used across the package."""

from __future__ import annotations

from pyspark.sql import types as T

# --- vocabularies -----------------------------------------------------------
# "Not known" is a member of each of these, never folded into a yes or a no.

TENDER, AWARD, OTHER = "tender", "award", "other"
NOTICE_KINDS = (AWARD, OTHER, TENDER)
NOTICE_TYPE_OF_KIND = {TENDER: "cn-standard", AWARD: "can-standard"}

AWARDED, DESIERTO, UNKNOWN = "awarded", "desierto", "unknown"
RESOLVED_OUTCOMES = (AWARDED, DESIERTO)

LOT_AWARDED, LOT_CLOSED = "selec-w", "clos-nw"

MATCH, MISMATCH, NO_GROUND_TRUTH = "match", "mismatch", "no_ground_truth"
GRADED_FIELDS = ("budget", "cpv_primary", "deadline")

PASS, FAIL, UNVERIFIED, NOT_APPLICABLE = "pass", "fail", "unverified", "not_applicable"
ELIGIBLE, NOT_ELIGIBLE = "eligible", "not_eligible"

LEGAL, TECHNICAL = "legal", "technical"

# Languages tried first when a field is published in several, in this order.
PREFERRED_LANGUAGES = ("spa", "eng")

# --- tables -----------------------------------------------------------------

_STRINGS = T.ArrayType(T.StringType())
_DOUBLES = T.ArrayType(T.DoubleType())


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


NOTICES = _struct(
    ("publication_number", T.StringType()),
    ("notice_type", T.StringType()),
    ("kind", T.StringType()),
    ("procedure_id", T.StringType()),
    ("is_eforms", T.BooleanType()),
    ("cpv", _STRINGS),
    ("cpv_primary", T.StringType()),
    ("buyer_name", T.StringType()),
    ("title", T.StringType()),
    ("publication_date", T.DateType()),
    ("deadline", T.DateType()),
    ("estimated_value", T.DoubleType()),
    ("winner_names", _STRINGS),
    ("winner_selection_status", _STRINGS),
    ("award_outcome", T.StringType()),
    ("tender_values", _DOUBLES),
    ("result_value", T.DoubleType()),
)

DOCUMENT = _struct(("kind", T.StringType()), ("name", T.StringType()), ("uri", T.StringType()))

TENDERS = _struct(
    ("entry_id", T.StringType()),
    ("expediente", T.StringType()),
    ("title", T.StringType()),
    ("budget", T.DoubleType()),
    ("cpv_primary", T.StringType()),
    ("deadline", T.DateType()),
    ("documents", T.ArrayType(DOCUMENT)),
)

PROCEDURE_LINKS = _struct(
    ("procedure_id", T.StringType()),
    ("tender_pub", T.StringType()),
    ("tender_date", T.DateType()),
    ("award_pub", T.StringType()),
    ("award_date", T.DateType()),
    ("outcome", T.StringType()),
    ("result_value", T.DoubleType()),
    ("lag_days", T.LongType()),
)

EXTRACTIONS = _struct(
    ("tender_id", T.StringType()),
    ("budget", T.DoubleType()),
    ("cpv_primary", T.StringType()),
    ("deadline", T.DateType()),
    ("solvency_turnover_required", T.DoubleType()),
    ("required_certifications", _STRINGS),
    ("price_weight_pct", T.DoubleType()),
    ("lots", T.IntegerType()),
)

PROFILES = _struct(
    ("name", T.StringType()),
    ("cpv_prefixes", _STRINGS),
    ("annual_turnover", T.DoubleType()),
    ("certifications", _STRINGS),
    ("max_contract_value", T.DoubleType()),
)

# --- landed inputs ----------------------------------------------------------

# The notice fields read from a landed page; everything else on a hit is skipped.
# The field names of the published search service.
NOTICE_FIELDS = (
    "publication-number",
    "notice-type",
    "procedure-identifier",
    "classification-cpv",
    "buyer-name",
    "notice-title",
    "publication-date",
    "deadline-receipt-tender-date-lot",
    "estimated-value-lot",
    "winner-name",
    "winner-selection-status",
    "tender-value",
    "result-value-notice",
)

# One page of hits; each hit stays raw JSON text until `normalize` types it.
NOTICE_PAGE = _struct(("notices", _STRINGS))

# One feed entry. Amounts and codes may carry attributes, hence the `_VALUE` wrapper.
# Elements are matched by local name; repeated ones are arrays so the first can be taken.
_TEXT = _struct(("_VALUE", T.StringType()))
_TEXTS = T.ArrayType(_TEXT)
_REFERENCES = T.ArrayType(
    _struct(
        ("ID", _TEXTS),
        ("Attachment", _struct(("ExternalReference", _struct(("URI", _TEXTS))))),
    )
)
_COMMODITIES = T.ArrayType(_struct(("ItemClassificationCode", _TEXTS)))
_PROJECT = _struct(
    ("Name", _TEXTS),
    (
        "BudgetAmount",
        T.ArrayType(_struct(("TaxExclusiveAmount", _TEXTS), ("EstimatedOverallContractAmount", _TEXTS))),
    ),
    ("RequiredCommodityClassification", _COMMODITIES),
)

_PROCESSES = T.ArrayType(
    _struct(("TenderSubmissionDeadlinePeriod", T.ArrayType(_struct(("EndDate", _TEXTS)))))
)

FEED_ENTRY = _struct(
    ("id", _TEXTS),
    (
        "ContractFolderStatus",
        _struct(
            ("ContractFolderID", _TEXTS),
            ("ProcurementProject", T.ArrayType(_PROJECT)),
            (
                "ProcurementProjectLot",
                T.ArrayType(_struct(("ProcurementProject", T.ArrayType(_PROJECT)), ("TenderingProcess", _PROCESSES))),
            ),
            ("TenderingProcess", _PROCESSES),
            ("LegalDocumentReference", _REFERENCES),
            ("TechnicalDocumentReference", _REFERENCES),
        ),
    ),
)
