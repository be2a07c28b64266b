"""Vocabularies, weights and rule tables: small constants that become literal expressions or
broadcast dimension tables."""

from __future__ import annotations

# --- fixed values: ids, orders and weights that results depend on -------------------------
CATEGORIES = (
    "F1_SETTLEMENT_AND_AUDIT", "F2_REVENUE_AND_DEDUCTIONS", "F3_PAYMENT_AND_CASHFLOW", "F4_MG_AND_RECOUPMENT", "F5_IP_MONETIZATION",
    "F6_TERM_EXCLUSIVITY_AND_OPPORTUNITY_COST", "F7_TERMINATION_LIABILITY_AND_PENALTIES", "F8_SCOPE_CREEP_AND_PRODUCTION_COST", "F9_E_CONTRACT_PRIVACY_AND_EVIDENCE",
)
SHORT = tuple(c[:2] for c in CATEGORIES)
TIER_FACTOR = {"A0": 1.0, "A1": 0.9, "A2": 0.8}
TIER_ORDER = {"A0": 0, "A1": 1, "A2": 2, "B": 3, "C": 4}
UNKNOWN_TIER = 99
CONF_FLOOR, SATURATION, CATEGORY_WEIGHT, SEVERITY_WEIGHT = 0.5, 1.5, 1.0, 1.0
CONFIDENCE_WEIGHTS = (0.3, 0.4, 0.3)
UNVERIFIED_FACTOR, BASE_EVIDENCE, FLAG_WEIGHT = 0.75, 1.0, 0.10
REVIEW_MINUTES = {"base": 5, "page": 2, "correction": 1, "flagged": 3, "missing": 2}
PROFESSIONAL_SCORE, NEGOTIATION_SCORE, DISPUTE_DELAY_DAYS = 70, 35, 30
MODULE_OF = {"F1": "FIM-1", "F2": "FIM-1", "F3": "FIM-2", "F4": "FIM-3", "F5": "FIM-6", "F6": "FIM-5", "F7": "FIM-7", "F8": "FIM-4", "F9": "FIM-8"}
TYPE_OF = {
    "F1": "revenue_leakage", "F2": "revenue_leakage", "F3": "present_value_loss", "F4": "cashflow_deferral", "F5": "opportunity_cost",
    "F6": "opportunity_cost", "F7": "liability_exposure", "F8": "revenue_leakage", "F9": None,
}
TYPE_ORDER = {"liability_exposure": 0, "revenue_leakage": 1, "present_value_loss": 2, "opportunity_cost": 3, "cashflow_deferral": 4}
BM25_K1, BM25_B = 1.5, 0.75
HEAD_BASE, HEAD_RISK, HEAD_PROTECTION, HEAD_THRESHOLD = 0.52, 0.14, 0.30, 0.5
EMBEDDING_WORDS = ("정산", "지급", "revenue", "share", "배분", "공제", "권리", "위약")

# --- rules and phrases of this repository ------------------------------------------------
#: (rule, category, kind, topic, protection, severity, confidence); patterns are RE2-safe.
RULES = (
    ("F1-P", "F1", "presence", r"(?i)statement and is final|정산\s*내역을\s*제공하지", None, 0.65, 0.8),
    ("F1-M", "F1", "missing_protection", r"(?i)settlement|정산", r"(?i)inspect|audit|열람", 0.70, 0.7),
    ("F2-P", "F2", "presence", r"(?i)any costs|기타\s*비용", None, 0.75, 0.8),
    ("F2-M", "F2", "missing_protection", r"(?i)net revenue|공제", r"(?i)listed in annex|항목을\s*명시", 0.70, 0.6),
    ("F3-P", "F3", "presence", r"(?i)bears no interest|지연\s*이자\s*없", None, 0.60, 0.8),
    ("F3-M", "F3", "missing_protection", r"(?i)payment|지급", r"(?i)due date|지급일", 0.60, 0.45),
    ("F4-P", "F4", "presence", r"(?i)until recouped|전액\s*회수", None, 0.70, 0.8),
    ("F4-M", "F4", "missing_protection", r"(?i)advance|선급금", r"(?i)cap on recoupment|회수\s*한도", 0.70, 0.6),
    ("F5-P", "F5", "presence", r"(?i)all secondary rights|모든\s*2차", None, 0.80, 0.9),
    ("F5-M", "F5", "missing_protection", r"(?i)secondary rights|2차", r"(?i)separate agreement|별도\s*계약", 0.80, 0.6),
    ("F6-P", "F6", "presence", r"(?i)renews automatically|자동으로\s*갱신", None, 0.65, 0.8),
    ("F6-M", "F6", "missing_protection", r"(?i)exclusive|독점", r"(?i)reversion|권리\s*반환", 0.65, 0.6),
    ("F7-P", "F7", "presence", r"(?i)without limit|상한\s*없이", None, 0.85, 0.9),
    ("F7-M", "F7", "missing_protection", r"(?i)liable|penalt|위약", r"(?i)liability cap|책임\s*상한", 0.85, 0.6),
    ("F8-P", "F8", "presence", r"(?i)at no added fee|무상으로\s*수정", None, 0.65, 0.8),
    ("F8-M", "F8", "missing_protection", r"(?i)revision|수정", r"(?i)two rounds|2회", 0.65, 0.6),
    ("F9-P", "F9", "presence", r"(?i)kept in electronic form|전자\s*문서", None, 0.55, 0.7),
    ("F9-M", "F9", "missing_protection", r"(?i)signed copies|서명본", r"(?i)both parties|양\s*당사자", 0.55, 0.6),
)
#: Model heads: (category, risk patterns, protection patterns, severity).
HEADS = (
    ("F2", (r"(?i)deduct", r"(?i)any costs", r"기타"), (r"(?i)listed",), 0.70),
    ("F3", (r"(?i)90 days", r"(?i)late payment"), (r"(?i)interest at",), 0.60),
    ("F5", (r"(?i)all secondary", r"(?i)without further payment"), (r"(?i)separate agreement",), 0.80),
    ("F6", (r"독점", r"자동"), (r"통지",), 0.65),
    ("F7", (r"(?i)every loss", r"(?i)without limit"), (r"(?i)cap",), 0.85),
)
#: Clause texts in the words of this repository; queries pick one by a key.
PHRASES = (
    "The publisher keeps settlement records, and the author may inspect them once a year.",
    "Settlement follows the publisher's own statement and is final.",
    "Net revenue means receipts after any costs the platform decides to deduct.",
    "정산 금액에서 기타 비용을 공제할 수 있다.",
    "Payment is made within 90 days after the close of the quarter; late payment bears no interest.",
    "선급금은 전액 회수될 때까지 수익 배분에서 차감한다.",
    "The author transfers all secondary rights, including film and translation, without further payment.",
    "독점 기간은 5년이며 별도 통지가 없으면 자동으로 갱신된다.",
    "The author is liable for every loss without limit, and penalties follow on termination.",
    "Revisions are made on request at no added fee.",
    "Signed copies are kept in electronic form by the platform.",
    "The parties may use each other's names in press releases.",
)
#: Short mixed texts.
KOREAN = ("정산 내역을 열람", "가", "MG 선급금 100만원", "권리 반환 clause 2차", "독점기간")
