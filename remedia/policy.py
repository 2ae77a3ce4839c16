"""Tables, thresholds and wording that results must agree on.

Nothing here is computed. Changing any of these values changes results.
"""

from __future__ import annotations

# --- fixed values: regulations and issues -----------------------------------

REGULATIONS = ["REG_E", "REG_Z", "FCRA", "FDCPA"]
DEFAULT_REGULATION = "REG_E"

ISSUES_BY_REGULATION = {
    "REG_E": [
        "Unauthorized transactions or other transaction problem",
        "Fraud or scam",
        "Managing an account",
        "Closing an account",
        "Problem caused by your funds being low",
        "Trouble using your card",
        "Problem with a lender or other company charging your account",
        "Money was not available when promised",
        "Confusing or missing disclosures",
    ],
    "REG_Z": [
        "Problem with a purchase shown on your statement",
        "Other features, terms, or problems",
        "Getting a credit card",
        "Charged fees or interest you didn't expect",
        "Struggling to repay your loan",
    ],
    "FCRA": [
        "Incorrect information on your report",
        "Problem with a company's investigation into an existing problem",
        "Improper use of your report",
    ],
    "FDCPA": [
        "Attempts to collect debt not owed",
        "Written notification about debt",
        "Communication tactics",
    ],
}
REGULATION_OF_ISSUE = {i: r for r, issues in ISSUES_BY_REGULATION.items() for i in issues}
KNOWN_ISSUES = list(REGULATION_OF_ISSUE)

RESPONSE_CATEGORIES = [
    "Closed with explanation",
    "Closed with monetary relief",
    "Closed with non-monetary relief",
    "Closed without relief",
    "Untimely response",
]
RELIEF_CATEGORIES = ["Closed with monetary relief", "Closed with non-monetary relief"]

FRAUD_FEATURES = [
    "income", "name_email_similarity", "prev_address_months_count",
    "current_address_months_count", "customer_age", "days_since_request",
    "intended_balcon_amount", "zip_count_4w", "velocity_6h", "velocity_24h",
    "velocity_4w", "bank_branch_count_8w", "date_of_birth_distinct_emails_4w",
    "credit_risk_score", "email_is_free", "phone_home_valid", "phone_mobile_valid",
    "has_other_cards", "proposed_credit_limit", "foreign_request",
    "session_length_in_minutes", "device_distinct_emails_8w", "device_fraud_count",
    "keep_alive_session", "bank_months_count",
]

# --- fixed values: card network reason codes ---------------------------------
# code, network, label, category, issuer window in days, regulation, evidence

REASON_CODES = [
    ("10.4", "Visa", "Other Fraud - Card Absent Environment", "fraud", 120, "REG_E",
     ["cardholder statement of unauthorised use", "transaction detail", "device and IP data"]),
    ("10.1", "Visa", "EMV Liability Shift Counterfeit Fraud", "fraud", 120, "REG_E",
     ["terminal capability data", "cardholder statement"]),
    ("13.1", "Visa", "Merchandise/Services Not Received", "consumer_dispute", 120, "REG_Z",
     ["expected delivery date", "proof of non-delivery", "attempt to resolve with the merchant"]),
    ("13.3", "Visa", "Not as Described or Defective Merchandise", "consumer_dispute", 120, "REG_Z",
     ["description as advertised", "condition on receipt", "return or attempted return"]),
    ("13.6", "Visa", "Credit Not Processed", "consumer_dispute", 120, "REG_Z",
     ["merchant refund policy", "proof of return", "date credit was promised"]),
    ("13.7", "Visa", "Cancelled Merchandise/Services", "consumer_dispute", 120, "REG_Z",
     ["cancellation date and method", "merchant cancellation terms"]),
    ("12.5", "Visa", "Incorrect Amount", "processing_error", 120, "REG_Z",
     ["receipt showing the agreed amount", "statement entry"]),
    ("12.6.1", "Visa", "Duplicate Processing", "processing_error", 120, "REG_Z",
     ["both statement entries", "single receipt"]),
    ("4837", "Mastercard", "No Cardholder Authorisation", "fraud", 120, "REG_E",
     ["cardholder statement of unauthorised use", "transaction detail"]),
    ("4853", "Mastercard", "Cardholder Dispute", "consumer_dispute", 120, "REG_Z",
     ["merchant contact attempt", "supporting documentation of the dispute"]),
    ("4834", "Mastercard", "Point-of-Interaction Error", "processing_error", 90, "REG_Z",
     ["receipt", "statement entry", "terminal data"]),
]

REASON_CODE_OF_ISSUE = {
    "Unauthorized transactions or other transaction problem": "10.4",
    "Fraud or scam": "10.4",
    "Problem with a purchase shown on your statement": "13.1",
    "Charged fees or interest you didn't expect": "12.5",
    "Trouble using your card": "4834",
    "Problem with a lender or other company charging your account": "12.6.1",
}
UNKNOWN_CODE_REASON = (
    "reason code not in the mapping table; route to a human rather than assume the nearest match")
NO_CODE_REASON = (
    "no reason code supplied and the issue does not map to one; a card-network dispute may not apply")

# --- fixed values: thresholds -------------------------------------------------

COMPLAINT_SPLIT_DATES = ("2023-04-01", "2023-11-01")
FRAUD_SPLIT_MONTHS = (5, 6)
AMOUNT_TOLERANCE = 0.01
PSI_STABLE, PSI_ALERT = 0.10, 0.25
PSI_FLOOR = 1e-6
HIGH_VALUE_AMOUNT = 750.0
ESCALATION_HIGH, ESCALATION_LOW = 0.65, 0.35
CHALLENGER_CONFIDENCE = 0.35
ALERT_BUDGET = 0.02
MAX_DRAFT_ATTEMPTS = 3
BM25_K1, BM25_B = 1.2, 0.7
RRF_K, CANDIDATE_K, TOP_K, EMBED_DIM = 60, 20, 4, 96
RERANK_POSITION, RERANK_COVERED, RERANK_TITLE = 3.0, 1.5, 0.9
RERANK_REGULATION, RERANK_CIRCULAR = 2.6, 0.35

GATES = [
    ("deadline_exactness", 1.0),
    ("citation_resolution", 0.99),
    ("rag_recall_at_k", 0.80),
    ("issue_macro_f1", 0.78),
    ("outcome_balanced_accuracy", 0.25),
    ("escalation_roc_auc", 0.66),
    ("fraud_recall_at_budget", 0.10),
]

# name of a stated deadline -> what the rules say
RULE_CONSTANTS = {
    "reg_e_initial_business_days": 10,
    "reg_e_new_account_business_days": 20,
    "reg_e_notice_calendar_days": 60,
    "reg_z_notice_calendar_days": 60,
    "reg_z_resolution_cap_days": 90,
    "fcra_reinvestigation_days": 30,
    "fdcpa_validation_notice_days": 5,
    "fdcpa_dispute_window_days": 30,
}

DIFFICULTY_WEIGHTS = {
    "deadline_count": 0.25,
    "extension_branch": 0.25,
    "out_of_time": 0.20,
    "validation_problem": 0.15,
    "unmapped_reason_code": 0.10,
    "narrative_noise": 0.05,
}
STATEMENT_GAPS = [5, 12, 20, 35, 58, 64, 80]

# --- fixed values: tokeniser ---------------------------------------------------

STOP_WORDS = (
    "a an and are as at be by for from has have in is it its of on or that the to was were "
    "will with this these those which what when where how why does do can could should would "
    "must may shall"
).split()

# applied one after another, in this order
NUMBER_PHRASES = [
    (r"\bsixty\b", "sixty 60"),
    (r"\b60\b", "60 sixty"),
    (r"\bforty[-\s]?five\b", "forty-five 45"),
    (r"\b45\b", "45 forty-five"),
    (r"\bthirty\b", "thirty 30"),
    (r"\b30\b", "30 thirty"),
    (r"\btwenty\b", "twenty 20"),
    (r"\b20\b", "20 twenty"),
    (r"\bninety\b", "ninety 90"),
    (r"\b90\b", "90 ninety"),
    (r"\bten\b", "ten 10"),
    (r"\b10\b", "10 ten"),
    (r"\bfive\b", "five 5"),
    (r"\bthree\b", "three 3"),
    (r"\btwo\b", "two 2"),
]

SYNONYMS = {
    "chargeback": ["billing", "error", "dispute"],
    "refund": ["credit", "correct"],
    "reversed": ["credit", "correct"],
    "temporary": ["provisional"],
    "stolen": ["unauthorized"],
    "hacked": ["unauthorized"],
    "skimmed": ["unauthorized"],
    "deadline": ["days", "period", "within"],
    "timeframe": ["days", "period", "within"],
    "cap": ["liability", "exceed"],
    "limit": ["liability", "exceed"],
    "harassment": ["harass", "abuse", "oppress"],
    "robocall": ["telephone", "repeatedly"],
    "validation": ["verification", "verify"],
    "tradeline": ["item", "information", "file"],
    "reinvestigate": ["reinvestigation"],
    "furnisher": ["furnisher", "person", "provided"],
    "atm": ["electronic", "fund", "transfer"],
    "ach": ["preauthorized", "electronic", "fund", "transfer"],
    "autopay": ["preauthorized"],
    "subscription": ["preauthorized", "recurring"],
}

# --- fixed values: letter checking ----------------------------------------------

CITATION_PATTERN = r"\[(?:reg|calc):([A-Za-z0-9_.()\-]+)\]"
DATE_PATTERN = r"(?U)\b(\d{4}-\d{2}-\d{2})\b"
SENTENCE_PATTERN = r"(?U)(?<=[.!?])\s+"
FACT_MARKERS = [
    "must", "shall", "required", "days", "liability", "entitled", "may not", "within"]
BOILERPLATE = [
    "thank you", "we will write", "if you have further", "re:", "we have opened",
    "a specialist is reviewing", "send them"]
DEFAULT_NOTICE_CITATION = "1005.11(b)"

# --- fixed values: letter wording -------------------------------------------------

LETTER_THANKS = (
    "Thank you for contacting us. We have opened an investigation into the transaction you describe.")
LETTER_LATE = (
    "We have recorded that your notice reached us after the notice period closed. We will still "
    "review what happened, but the statutory error resolution timetable does not apply to a notice "
    "received outside that window [reg:")
LETTER_CODE = "We have raised this with the card network under reason code "
LETTER_EVIDENCE = "To support it we need: "
LETTER_UNMAPPED = (
    "We could not map this dispute to a card network reason code automatically, so a specialist is "
    "reviewing which route applies.")
LETTER_CLOSING = (
    "We will write to you again when the investigation concludes. If you have further documents, "
    "send them and we will add them to the file.")
HEADING_APPLIES = "## What applies to your dispute"
HEADING_DATES = "## Dates that apply"
HEADING_MEANS = "## What this means"
HEADING_NEEDED = "## Information we still need"

LIABILITY_NOTE = (
    "The cap is the lesser of this amount and the value of the unauthorized transfers occurring in "
    "the relevant window; it is a ceiling, not a charge.")
