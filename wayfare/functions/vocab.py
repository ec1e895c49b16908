"""Event vocabulary: logical events as ``Column`` predicates.

Rule order matters wherever rules overlap (a funnel URL also contains
``journeys/``), so every classifier is an ordered ``when`` chain.

NULL semantics are deliberate and follow the warehouse queries: ``!=``
against a NULL parameter is NULL, which drops the row in a filter.  The
three purchase variants differ exactly there and are kept separate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


# ---------------------------------------------------------------------------
# Event names, parameter values, URL fragments and labels the
# analyses are defined on.  Host names are configurable (`Vocab` below);
# the defaults are neutral placeholders used by the driver-table adapter.
# ---------------------------------------------------------------------------
PAGE_VIEW = "page_view"
GENERATE_LEAD = "generate_lead"
PURCHASE = "purchase"
BEGIN_CHECKOUT = "begin_checkout"
EXPERIMENT_VIEWED = "experiment_viewed"
CONTENT_CTA = "content_cta"
REQUEST_CALL_BACK = "request_call_back_confirmation"
REQUEST_QUOTE = "request_quote_confirmation"
REQUEST_BROCHURE = "request_brochure_confirmation"
FYC_FILTER = "find_your_cruise_filter"
LEAD_WEBQ = "generate_lead_WEBQ"
LEAD_WBOF_01 = "generate_lead_WBOF_01"
LEAD_WBOF_04 = "generate_lead_WBOF_04"
LEAD_RAB = "generate_lead_RAB"
LEAD_RAQ = "generate_lead_RAQ"
LEAD_SFO = "generate_lead_SFO"
LEAD_WBBK = "generate_lead_WBBK"
LEAD_WBCH = "generate_lead_WBCH"

LEAD_NAME_BOOKING = "booking"
PAYMENT_TOTAL = "total"
PAYMENT_FREE = "free"
BOOKING_STATUS_OPTION = "option"
DESTEX_YES = "YES"
DESTEX_NO = "NO"
CTA_POPUP = "popup_funnel"
CTA_POPUP_SEEN = "popup_seen"
CTA_RETURN_TO_FUNNEL = "return_to_funnel"

HOLD = "Booking Hold"
PURCHASE_LABEL = "Purchase"
ANY_LABEL = "Any (OR)"

SUITE_STEP_FRAGMENT = "/booking?step=suites"
ITINERARY_FRAGMENT = "journeys/"
VS_MEDIUM_PATTERN = "%utm_medium=email%"
VS_TAG_PATTERN = "%_VS_%"
INDIVIDUAL_ID_REGEX = r"IndividualId=(\d+)"
CRUISE_ID_REGEX = r"/cruises/([^/?]+)"
DESTINATION_ID_REGEX = r"/destinations/([^/?]+)"
CRUISES_PATTERN = "%/cruises/%"
DESTINATIONS_PATTERN = "%/destinations/%"
GUESTS_INFO_PATTERN = "%/guests-info%"
DEPARTURE_FORMATS = ["yyyy-MM-dd", "dd-MM-yyyy"]
FUNNEL_STEPS = ["guests", "category", "fare"]
WEBQ_STEPS = ["guests WEBQ", "category WEBQ", "fare WEBQ"]


@dataclass(frozen=True)
class Vocab:
    """Site-specific URL fragments (defaults are placeholders)."""
    funnel_host: str = "booking.cruise-line.test/touchb2c"
    quote_host: str = "quote.cruise-line.test"
    personal_area_regex: str = "my-area|about"
    itinerary_fragment: str = ITINERARY_FRAGMENT
    suite_step_fragment: str = SUITE_STEP_FRAGMENT
    personal_area_like: str = "%my-area%"


DEFAULT_VOCAB = Vocab()


def booking_hold(strict: bool = False) -> Column:
    """Loose: generate_lead with lead_name='booking'.  Strict adds free + option."""
    c = (F.col("event_name") == GENERATE_LEAD) & (F.col("lead_name") == LEAD_NAME_BOOKING)
    if strict:
        c = c & (F.col("payment_type") == PAYMENT_FREE) & (F.col("booking_status") == BOOKING_STATUS_OPTION)
    return c


def purchase(variant: str = "A") -> Column:
    """Three purchase definitions that disagree on NULL parameters.

    A: destex != 'YES' and payment != 'total' (NULL in either drops the row)
    B: destex  = 'NO'  and payment != 'total' (NULL payment drops the row)
    C: destex  = 'NO'  and coalesce(payment,'') != 'total' (NULL payment kept)
    """
    e = F.col("event_name") == PURCHASE
    if variant == "A":
        return e & (F.col("p_journey_is_destex") != DESTEX_YES) & (F.col("payment_type") != PAYMENT_TOTAL)
    if variant == "B":
        return e & (F.col("p_journey_is_destex") == DESTEX_NO) & (F.col("payment_type") != PAYMENT_TOTAL)
    if variant == "C":
        return e & (F.col("p_journey_is_destex") == DESTEX_NO) & \
            (F.coalesce(F.col("payment_type"), F.lit("")) != PAYMENT_TOTAL)
    raise ValueError("variant must be A, B or C")


def page_group(url: Column | None = None, vocab: Vocab = DEFAULT_VOCAB) -> Column:
    """'Funnel' is tested first (funnel URLs also contain the itinerary fragment)."""
    u = F.col("page_location") if url is None else url
    return (F.when(u.like(f"%{vocab.funnel_host}%"), F.lit("Funnel"))
            .when(u.like(f"%{vocab.itinerary_fragment}%") & ~u.rlike(vocab.personal_area_regex),
                  F.lit("Itinerary Page")))


def is_vs(url: Column | None = None, literal: bool = False) -> Column:
    """Email-campaign contact.  By default ``_`` is the LIKE one-character
    wildcard (the warehouse behaviour); ``literal=True`` requires the tag."""
    u = F.col("raw_url") if url is None else url
    tag = u.contains("_VS_") if literal else u.like(VS_TAG_PATTERN)
    return F.lower(u).like(VS_MEDIUM_PATTERN) & tag


def is_vs_coalesced(url: Column | None = None) -> Column:
    """Variant used by the feature builder: NULL URL counts as not-VS."""
    u = F.coalesce(F.col("raw_url") if url is None else url, F.lit(""))
    return F.lower(u).like(VS_MEDIUM_PATTERN) & u.like(VS_TAG_PATTERN)
