"""The star-schema sample tables in the roles of this package's tables.

Orders play tender notices, line items grouped by order and ship date play award notices,
parts play feed tenders and suppliers companies. Whether a value is missing, and in which of
its published shapes it comes, follows from remainders of the keys, so every case occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.functions.outcomes import award_outcome
from tenderloom.schemas import (
    AWARD,
    DESIERTO,
    AWARDED,
    LEGAL,
    LOT_AWARDED,
    LOT_CLOSED,
    NOTICE_TYPE_OF_KIND,
    NOTICES,
    TECHNICAL,
    TENDER,
    TENDERS,
)
from tenderloom.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(part) if isinstance(part, str) else part.cast("string") for part in parts])


def _code(key: Column) -> Column:
    return _text(key % 90 + 10, "000000")


def _unless(condition: Column, value: Column) -> Column:
    return F.when(~condition, value)


def _missing(name: str) -> Column:
    return F.lit(None).cast(NOTICES[name].dataType)


def _no_values(name: str) -> Column:
    return F.array().cast(NOTICES[name].dataType)


# --- notices ------------------------------------------------------------------


def tender_notices(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    return (
        table(spark, folder, "orders")
        .select(
            _text("T-", key).alias("publication_number"),
            F.lit(NOTICE_TYPE_OF_KIND[TENDER]).alias("notice_type"),
            F.lit(TENDER).alias("kind"),
            _unless(key % 11 == 0, _text("P-", key)).alias("procedure_id"),
            (key % 11 != 0).alias("is_eforms"),
            F.array(_code(key), F.lit("45000000")).alias("cpv"),
            _code(key).alias("cpv_primary"),
            _text("Buyer ", F.col("o_custkey")).alias("buyer_name"),
            _text("Contract ", key).alias("title"),
            F.col("o_orderdate").cast("date").alias("publication_date"),
            F.date_add(F.col("o_orderdate").cast("date"), 30).alias("deadline"),
            _unless(key % 13 == 0, F.col("o_totalprice")).alias("estimated_value"),
            _no_values("winner_names").alias("winner_names"),
            _no_values("winner_selection_status").alias("winner_selection_status"),
            _missing("award_outcome").alias("award_outcome"),
            _no_values("tender_values").alias("tender_values"),
            _missing("result_value").alias("result_value"),
        )
        .select(*NOTICES.names)
    )


def tender_notices_by_country(spark: SparkSession, folder: str) -> DataFrame:
    """Tender notices with the country of the buyer, as a landing partition would give it."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            _text("T-", F.col("o_orderkey")).alias("publication_number"),
            F.lit(NOTICE_TYPE_OF_KIND[TENDER]).alias("notice_type"),
            F.col("o_orderdate").cast("date").alias("publication_date"),
            "country",
        )
    )


def award_lots(spark: SparkSession, folder: str) -> DataFrame:
    """Award notices, one per order and month of shipping, with their lots in order: at most seven, as an
    order has."""
    flag = F.col("l_returnflag")
    shipped = F.col("l_shipdate").cast("date")
    return (
        table(spark, folder, "lineitem")
        .select(
            "l_orderkey",
            F.date_format(shipped, "yyyy-MM").alias("month"),
            shipped.alias("shipped"),
            F.struct(
                F.col("l_linenumber").alias("number"),
                F.when(flag == "N", LOT_AWARDED).when(flag == "R", LOT_CLOSED).alias("status"),
                F.when(flag == "N", F.col("l_extendedprice")).alias("price"),
                F.when(flag == "N", _text("S-", F.col("l_suppkey"))).alias("winner"),
            ).alias("lot"),
        )
        .groupBy("l_orderkey", "month")
        .agg(
            F.max("shipped").alias("publication_date"),
            F.array_sort(F.collect_list("lot")).alias("lots"),
            F.round(F.sum("lot.price"), 2).alias("result_value"),
        )
    )


def _of_lots(name: str) -> Column:
    """One value of each lot that has it, in order of the lots."""
    return F.array_compact(F.transform("lots", lambda lot: lot[name]))


def award_notices(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("l_orderkey")
    return (
        award_lots(spark, folder)
        .select(
            _text("W-", key, "-", F.col("month")).alias("publication_number"),
            F.lit(NOTICE_TYPE_OF_KIND[AWARD]).alias("notice_type"),
            F.lit(AWARD).alias("kind"),
            _text("P-", key).alias("procedure_id"),
            F.lit(True).alias("is_eforms"),
            F.array(_code(key)).alias("cpv"),
            _code(key).alias("cpv_primary"),
            _missing("buyer_name").alias("buyer_name"),
            _text("Award ", key).alias("title"),
            "publication_date",
            _missing("deadline").alias("deadline"),
            _missing("estimated_value").alias("estimated_value"),
            F.array_distinct(_of_lots("winner")).alias("winner_names"),
            _of_lots("status").alias("winner_selection_status"),
            _of_lots("price").alias("tender_values"),
            "result_value",
        )
        .withColumn("award_outcome", award_outcome(F.col("kind"), F.col("winner_selection_status")))
        .select(*NOTICES.names)
    )


def notices(spark: SparkSession, folder: str) -> DataFrame:
    return tender_notices(spark, folder).unionByName(award_notices(spark, folder))


def mixed_notice_types(spark: SparkSession, folder: str) -> DataFrame:
    """Notices of several types, named by order priority; one priority has no type at all."""
    types = {
        "1-URGENT": "cn-standard",
        "2-HIGH": "can-standard",
        "3-MEDIUM": "cn-social",
        "4-NOT SPECIFIED": "pin-only",
        "5-LOW": "can-modif",
    }
    priority = F.col("o_orderpriority")
    notice_type = F.lit("")
    for name, value in types.items():
        notice_type = F.when(priority == name, value).otherwise(notice_type)
    return table(spark, folder, "orders").select(
        _text("T-", F.col("o_orderkey")).alias("publication_number"), notice_type.alias("notice_type")
    )


# --- notices as landed JSON ---------------------------------------------------------


def _quoted(*parts: Column | str) -> Column:
    return _text('"', *parts, '"')


def _variants(selector: Column, shapes: dict[int, Column], otherwise: Column | None = None) -> Column:
    """One of several JSON texts by remainder; NULL leaves the field out."""
    chosen = otherwise if otherwise is not None else F.lit(None).cast("string")
    for remainder, shape in shapes.items():
        chosen = F.when(selector == remainder, shape).otherwise(chosen)
    return chosen


def _hit(fields: dict[str, Column]) -> Column:
    members = [F.concat(F.lit(f'"{name}":'), value) for name, value in fields.items()]
    return _text("{", F.concat_ws(",", *members), "}")


def tender_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Raw tender hits in the shapes the search service is known to use."""
    key, code = F.col("o_orderkey"), _code(F.col("o_orderkey"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    later = F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd")
    price = F.col("o_totalprice")
    fields = {
        "publication-number": _quoted("T-", key),
        "notice-type": _variants(key % 23, {0: F.lit(None).cast("string")}, _quoted("cn-standard")),
        "procedure-identifier": _variants(
            key % 11, {0: F.lit(None).cast("string"), 1: F.lit('""')}, _quoted("P-", key)
        ),
        "classification-cpv": _variants(
            key % 5,
            {
                0: _quoted(code),
                1: _text('["', code, '","45000000","', code, '"]'),
                2: _text('[null,"', code, '"]'),
                4: code,
            },
        ),
        "buyer-name": _variants(
            key % 4,
            {
                0: _text('{"spa":["Comprador ', key, '","Otro"]}'),
                1: _text('{"eng":"Buyer ', key, '"}'),
                2: _text('{"deu":[],"fra":["Acheteur ', key, '"],"bul":"Z"}'),
                3: F.lit("null"),
            },
        ),
        "notice-title": _variants(
            key % 6,
            {
                0: _text('{"deu":"D ', key, '","eng":"E ', key, '","spa":"S ', key, '"}'),
                1: _text('{"spa":["","x"],"eng":["E ', key, '"]}'),
                2: _quoted("[Lot] ", key),
                3: F.lit('""'),
                4: _text('{"pol":"P ', key, '","ces":"C ', key, '"}'),
                5: F.lit('["listed"]'),
            },
        ),
        "publication-date": _variants(key % 19, {0: _quoted("2025-02-30+01:00")}, _quoted(day, "+01:00")),
        "deadline-receipt-tender-date-lot": _variants(
            key % 7,
            {
                0: F.lit(None).cast("string"),
                1: _quoted(later, "+02:00"),
                2: _text('[null,"', later, '"]'),
                3: _quoted("2025-1-2"),
            },
            _text('["', later, '+02:00","2031-01-01+02:00"]'),
        ),
        "estimated-value-lot": _variants(
            key % 13,
            {0: F.lit(None).cast("string"), 1: F.lit('["n/a","1_000.5"]'), 2: price.cast("string"), 3: F.lit('"12d"')},
            _text('["', price, '","5"]'),
        ),
    }
    return table(spark, folder, "orders").select(key.alias("page_key"), _hit(fields).alias("notice"))


def award_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Raw award hits, one per order and month of shipping."""
    key, day = F.col("l_orderkey"), F.col("publication_date")
    statuses, winners, prices = _of_lots("status"), _of_lots("winner"), _of_lots("price")
    # Prices come as text and as numbers, with one entry that is neither.
    shown = F.transform(prices, lambda price, k: F.when(k % 2 == 0, _quoted(price)).otherwise(price.cast("string")))
    fields = {
        "publication-number": _quoted("W-", key, "-", F.col("month")),
        "notice-type": _quoted("can-standard"),
        "procedure-identifier": _quoted("P-", key),
        "classification-cpv": _text('["', _code(key), '","', _code(key), '"]'),
        "notice-title": _text('{"eng":"Award ', key, '"}'),
        "publication-date": _quoted(day, "+01:00"),
        "winner-name": F.when(
            F.size(winners) > 0,
            _text('{"spa":["', F.array_join(winners, '","'), '","","', F.get(winners, F.lit(0)), '"],"eng":["x"]}'),
        ),
        "winner-selection-status": F.when(F.size(statuses) > 0, F.to_json(statuses)),
        "tender-value": F.when(F.size(prices) > 0, _text("[", F.array_join(shown, ","), ',"bad"]')),
        "result-value-notice": _quoted(F.col("result_value")),
    }
    return award_lots(spark, folder).select(
        key.alias("page_key"), F.year(day).alias("year"), _hit(fields).alias("notice")
    )


def unnumbered_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Tender hits of which some have lost their number, and some can't be read at all."""
    number = r'"publication-number":"[^"]*",'
    lost = F.regexp_replace("notice", number, "")
    return tender_hits(spark, folder).select(
        F.when(F.col("page_key") % 37 == 0, lost)
        .when(F.col("page_key") % 41 == 0, F.substring("notice", 1, 30))
        .otherwise(F.col("notice"))
        .alias("notice")
    )


def notice_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of hits, one page per row.

    A page takes the orders of a key range, or the awards of a smaller one and a year: at most
    100 and 4 x 12 hits, whatever the size of the data.
    """
    tenders = tender_hits(spark, folder).select(
        F.floor(F.col("page_key") / 100).alias("page"), F.lit(0).alias("year"), "notice"
    )
    awards = award_hits(spark, folder).select(F.floor(F.col("page_key") / 4).alias("page"), "year", "notice")
    pages = tenders.unionByName(awards).groupBy("page", "year").agg(F.collect_list("notice").alias("hits"))
    return pages.select(
        _text(
            '{"notices":[',
            F.array_join("hits", ","),
            '],"totalNoticeCount":',
            F.size("hits"),
            ',"iterationNextToken":null}',
        ).alias("value")
    )


# --- feed tenders --------------------------------------------------------------------


def _numbered_documents(kind: str, count: Column, key: Column) -> Column:
    documents = F.transform(
        F.sequence(F.lit(1).cast("bigint"), count),
        lambda number: F.struct(
            F.lit(kind).alias("kind"),
            F.when(number != 2, _text(kind, " ", number, ".pdf")).alias("name"),
            _text("https://documents.example/", key, "/", kind, "/", number).alias("uri"),
        ),
    )
    return F.when(count > 0, documents).otherwise(F.array().cast(TENDERS["documents"].dataType))


def tenders(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        _text("PT-", key).alias("entry_id"),
        _text("EXP-", key).alias("expediente"),
        F.col("p_name").alias("title"),
        _unless(key % 13 == 0, F.col("p_retailprice") * 1000).alias("budget"),
        _unless(key % 17 == 0, _code(key)).alias("cpv_primary"),
        _unless(key % 7 == 0, F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size"))).alias("deadline"),
        F.concat(
            _numbered_documents(LEGAL, key % 3, key), _numbered_documents(TECHNICAL, key % 2, key)
        ).alias("documents"),
    )


def _element(name: str, *content: Column | str) -> Column:
    return _text(f"<{name}>", *content, f"</{name}>")


def _references(element: str, kind: str, count: Column, key: Column) -> Column:
    reference = F.transform(
        F.sequence(F.lit(1).cast("bigint"), count),
        lambda number: _element(
            element,
            _element("cbc:ID", " ", _text(kind, " ", number, ".pdf"), " "),
            _element(
                "cac:Attachment",
                _element(
                    "cac:ExternalReference",
                    _element("cbc:URI", _text("https://documents.example/", key, "/", kind, "/", number, "?a=1&amp;b=2")),
                ),
            ),
        ),
    )
    return F.when(count > 0, F.array_join(reference, "")).otherwise("")


def feed_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Feed entries as XML text, dealt out over the tasks while they are still narrow rows."""
    return _as_entries(spread(table(spark, folder, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")))


def _as_entries(parts: DataFrame) -> DataFrame:
    """Feed entries as XML text, with the blanks, gaps and decoys that entries are known to have."""
    key, amount = F.col("p_partkey"), F.col("p_retailprice") * 1000
    taxed = _text('<cbc:TaxExclusiveAmount currencyID="EUR">', amount, "</cbc:TaxExclusiveAmount>")
    estimate = _element("cbc:EstimatedOverallContractAmount", amount + 1)
    total = _element("cbc:TotalAmount", "9")
    budget = _variants(
        key % 13,
        {
            0: F.lit(""),
            1: _element("cac:BudgetAmount", "<cbc:TaxExclusiveAmount> </cbc:TaxExclusiveAmount>", estimate, total),
            2: _element("cac:BudgetAmount", "<cbc:TaxExclusiveAmount>n/a</cbc:TaxExclusiveAmount>", estimate),
        },
        _element("cac:BudgetAmount", estimate, total, taxed),
    )

    def commodity(code: Column | str) -> Column:
        return _element(
            "cac:RequiredCommodityClassification",
            '<cbc:ItemClassificationCode listURI="urn:codes">',
            code,
            "</cbc:ItemClassificationCode>",
        )

    codes = F.when(key % 17 == 0, F.lit("")).otherwise(_text(commodity(_code(key)), commodity("99000000")))
    lot = F.when(
        key % 34 == 0,
        _element(
            "cac:ProcurementProjectLot",
            _element("cac:ProcurementProject", _element("cbc:Name", "lot name"), commodity("98000000")),
            _element(
                "cac:TenderingProcess",
                _element("cac:TenderSubmissionDeadlinePeriod", _element("cbc:EndDate", "2026-06-01+02:00")),
            ),
        ),
    ).otherwise("")
    deadline = F.when(key % 7 == 0, F.lit("")).otherwise(
        _element(
            "cac:TenderSubmissionDeadlinePeriod",
            _element("cbc:EndDate", F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size")), "+02:00"),
        )
    )
    no_link = F.when(
        key % 4 == 0, _element("cac:LegalDocumentReference", _element("cbc:ID", "no link"))
    ).otherwise("")
    entry = _element(
        "entry",
        _element("id", F.when(key % 29 == 0, F.lit(" ")).otherwise(_text("PT-", key))),
        _element("title", "not this title"),
        _element(
            "ext:ContractFolderStatus",
            _element("cbc:ContractFolderID", " EXP-", key, "\t"),
            _element("cac:ProcurementProject", _element("cbc:Name", F.col("p_name")), budget, codes),
            lot,
            _element(
                "cac:TenderingProcess",
                _element("cac:DocumentAvailabilityPeriod", _element("cbc:EndDate", "2025-12-31")),
                deadline,
            ),
            no_link,
            _references("cac:LegalDocumentReference", LEGAL, key % 3, key),
            _references("cac:TechnicalDocumentReference", TECHNICAL, key % 2, key),
            _references("cac:AdditionalDocumentReference", "additional", F.lit(1).cast("bigint"), key),
        ),
    )
    return parts.select(key.alias("page_key"), entry.alias("entry"))


def feed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Feed pages of at most 1,000 entries, with a deletion mark before them; one page per row."""
    pages = (
        _as_entries(table(spark, folder, "part"))
        .groupBy(F.floor(F.col("page_key") / 1000).alias("page"))
        .agg(F.collect_list("entry").alias("entries"))
    )
    head = '<feed xmlns="urn:feed" xmlns:cbc="urn:b" xmlns:cac="urn:a" xmlns:ext="urn:e" xmlns:at="urn:t"><id>feed</id>'
    return pages.select(
        _text(head, '<at:deleted-entry ref="gone"/>', F.array_join("entries", ""), "</feed>").alias("value")
    )


# --- companies, requirements, extractions, predictions, documents --------------------


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    digit = (key % 9 + 1).cast("string")
    return table(spark, folder, "supplier").select(
        F.col("s_name").alias("name"),
        F.when(key % 7 == 0, F.lit(None))
        .when(key % 11 == 0, F.array().cast("array<string>"))
        .when(key % 4 == 1, F.array(digit, F.lit("45")))
        .otherwise(F.array(digit))
        .alias("cpv_prefixes"),
        _unless(key % 5 == 0, F.col("s_acctbal") * 100).alias("annual_turnover"),
        F.when(key % 6 == 0, F.array(F.lit("ISO 9001"), F.lit("iso 14001")))
        .when(key % 2 == 0, F.array(F.lit("ISO 9001")))
        .when(key % 3 == 0, F.array(F.lit("\tiso 14001")))
        .alias("certifications"),
        _unless(key % 3 == 0, F.col("s_acctbal") * 500).alias("max_contract_value"),
    )


def requirements(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        _text("PT-", key).alias("tender_id"),
        _unless(key % 5 == 0, F.col("p_retailprice") * 300).alias("solvency_turnover_required"),
        F.when(key % 4 == 1, F.array(F.lit(" iso 9001 ")))
        .when(key % 4 == 2, F.array(F.lit("ISO 14001"), F.lit("Iso 9001")))
        .when(key % 4 == 3, F.array(F.lit("ISO 14001")))
        .alias("required_certifications"),
    )


def bids(spark: SparkSession, folder: str) -> DataFrame:
    """(tender, company) pairs to check: the parts each supplier has delivered."""
    return (
        table(spark, folder, "lineitem")
        .select("l_partkey", "l_suppkey")
        .distinct()
        .select(
            _text("PT-", F.col("l_partkey")).alias("tender_id"),
            _text("Supplier#", F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("company"),
        )
    )


def extractions(spark: SparkSession, folder: str) -> DataFrame:
    """Exact, within tolerance, outside it, or missed; small parts were never read."""
    key, amount = F.col("p_partkey"), F.col("p_retailprice") * 1000
    return (
        table(spark, folder, "part")
        .where(F.col("p_size") > 5)
        .select(
            _text("PT-", key).alias("tender_id"),
            F.when(key % 4 == 1, amount * 1.004)
            .when(key % 4 == 2, amount * 1.02)
            .when(key % 4 == 3, amount)
            .alias("budget"),
            F.when(key % 6 == 0, F.lit("99999999")).otherwise(_text(" ", _code(key))).alias("cpv_primary"),
            _unless(key % 8 == 0, F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size"))).alias("deadline"),
        )
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        _text("T-", F.col("o_orderkey")).alias("tender_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", DESIERTO).otherwise(AWARDED).alias("predicted"),
    )


def document_costs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the model to read them; a quarter of the characters stands for a token count."""
    key = F.col("doc_id")
    return table(spark, folder, "documents").select(
        "doc_id",
        F.when(key % 3 == 0, "model-a").when(key % 3 == 1, "model-b").otherwise("unlisted").alias("model"),
        F.ceil(F.col("n_chars") / 4).cast("bigint").alias("input_tokens"),
    )


def landed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """First legal documents of the feed's tenders as landed; some are no PDF, some empty, some never came."""
    key = F.col("p_partkey")
    content = (
        F.when(key % 8 == 0, _text("<html>", F.col("p_name")))
        .when(key % 10 == 1, F.lit(""))
        .otherwise(_text("%PDF-1.7 ", F.col("p_name")))
    )
    return (
        table(spark, folder, "part")
        .where(key % 8 != 4)
        .select(
            _text("https://documents.example/", key, "/", LEGAL, "/1?a=1&b=2").alias("uri"),
            content.cast("binary").alias("content"),
        )
    )


def document_contents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as bytes; every third one carries the mark of a PDF file, every fifth a late one."""
    key = F.col("doc_id")
    content = (
        F.when(key % 3 == 0, _text("%PDF-1.7\n", F.col("text")))
        .when(key % 5 == 0, _text(" %PDF-", F.col("text")))
        .otherwise(F.col("text"))
    )
    return table(spark, folder, "documents").select("doc_id", content.cast("binary").alias("content"))


# --- corrections ---------------------------------------------------------------------


def notice_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Re-published tender notices: returned line items, several per order, plus unseen notices. Of some it is not
    known when they landed."""
    key = F.col("l_orderkey")
    return (
        table(spark, folder, "lineitem")
        .where(F.col("l_returnflag") == "R")
        .select(
            F.when(F.col("l_quantity") < 5, _text("N-", F.col("l_partkey")))
            .otherwise(_text("T-", key))
            .alias("publication_number"),
            F.col("l_shipdate").cast("date").alias("publication_date"),
            F.col("l_extendedprice").alias("estimated_value"),
            _text("Revision ", F.col("l_partkey"), "/", F.col("l_suppkey")).alias("title"),
            _unless(
                F.col("l_linenumber") % 3 == 0, F.struct("l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey")
            ).alias("landed"),
        )
    )


def second_landing(spark: SparkSession, folder: str, first: DataFrame | None = None) -> DataFrame:
    """Whole notices that are published again because something was wrong with them. `first` are the `notices` of the
    folder, where these have been stored.

    Tender notices dated on a weekend move to the day after, and in a second copy to Monday; those without a procedure
    get one; those without a value belong to the next procedure. Awards that nobody won are published a week later, for
    the next procedure.
    """
    key = F.regexp_extract("publication_number", r"^.-(\d+)", 1).cast("bigint")
    date, procedure = F.col("publication_date"), F.col("procedure_id")

    def again(first: DataFrame, landed: Column, new_date: Column, new_procedure: Column) -> DataFrame:
        changed = {"publication_date": new_date, "procedure_id": new_procedure}
        copies = first.withColumn("landed", landed).withColumns(changed)
        return copies.withColumn("is_eforms", procedure.isNotNull()).select(*NOTICES.names, "landed")

    if first is None:
        tenders_first, awards_first = tender_notices(spark, folder), award_notices(spark, folder)
    else:
        tenders_first, awards_first = [first.where(F.col("kind") == kind) for kind in (TENDER, AWARD)]
    day = F.weekday("publication_date")
    no_value = F.col("estimated_value").isNull()
    tenders_again = again(
        tenders_first.where((day >= 5) | procedure.isNull() | no_value),
        F.explode(F.array(F.lit(1), F.lit(2))),
        F.when(day < 5, date).when(F.col("landed") == 1, F.date_add(date, 1)).otherwise(F.date_add(date, 7 - day)),
        F.when(no_value, _text("P-", key + 1)).otherwise(F.coalesce(procedure, _text("P-", key))),
    )
    awards_again = again(
        awards_first.where(F.col("award_outcome") == DESIERTO),
        F.lit(3),
        F.date_add(date, 7),
        _text("P-", key + 1),
    )
    return tenders_again.unionByName(awards_again)


def tender_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Re-published feed tenders; those on the seventh line have lost their id."""
    return (
        table(spark, folder, "lineitem")
        .where(F.col("l_linestatus") == "F")
        .select(
            F.when(F.col("l_linenumber") == 7, F.lit(""))
            .when(F.col("l_quantity") < 5, _text("PX-", F.col("l_orderkey")))
            .otherwise(_text("PT-", F.col("l_partkey")))
            .alias("entry_id"),
            _text("Revision ", F.col("l_orderkey"), "/", F.col("l_suppkey")).alias("title"),
            F.col("l_extendedprice").alias("budget"),
            F.col("l_shipdate").cast("date").alias("deadline"),
            F.struct("l_shipdate", "l_extendedprice", "l_orderkey", "l_suppkey").alias("landed"),
        )
    )


def deletion_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Feed tenders that were taken back, some of them before or between their corrections."""
    return (
        table(spark, folder, "lineitem")
        .where((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 40))
        .select(
            _text("PT-", F.col("l_suppkey")).alias("entry_id"),
            F.struct("l_shipdate", "l_extendedprice", "l_orderkey", "l_suppkey").alias("landed"),
        )
    )
