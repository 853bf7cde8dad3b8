"""The bundled department rules.

Fixed values. A rule without an enforcement redacts, one without a threshold
triggers from 5.0 on; a threshold of 0.0 never triggers.
"""

from __future__ import annotations

DEFAULT_ENFORCEMENT, DEFAULT_THRESHOLD, DEFAULT_NAME = "redact", 5.0, "unnamed"
ENFORCEMENTS = ("warn", "redact", "block")


def _rule(name, description="", *, entities=(), keywords=(), enforcement=None, threshold=None, models=()):
    return {
        "name": name,
        "description": description,
        "entity_types": list(entities),
        "keywords": list(keywords),
        "enforcement": enforcement or DEFAULT_ENFORCEMENT,
        "risk_threshold": DEFAULT_THRESHOLD if threshold is None else threshold,
        "allowed_models": list(models),
    }


PRESETS = {
    "EU_GENERAL": [
        _rule("GDPR Cross-Border Block", "Prevent non-consented PII from leaving the EU jurisdiction."),
        _rule("VAT ID Masking", "Always mask EU VAT numbers for corporate data safety."),
        _rule("Bank IBAN Hard-Block", "Never allow European IBAN numbers to be processed by cloud-based AI."),
    ],
    "HOSPITAL": [
        _rule(
            "PHI Raw Leak Block",
            "Block any prompt that attempts to pass raw patient identifiers",
            entities=(
                "PERSON",
                "US_SSN",
                "MEDICAL_LICENSE",
                "PHONE_NUMBER",
                "UHID (Hospital ID)",
                "Aadhaar Number",
                "Ayushman Bharat ID",
            ),
            keywords=("patient id", "patient name", "uhid", "mrn", "medical record number"),
            enforcement="block",
            threshold=7.0,
        ),
        _rule(
            "Clinical Diagnosis Redact",
            "Redact clinical diagnoses, ICD codes, and prescription details",
            keywords=(
                "diagnosis",
                "prescribed",
                "ICD-",
                "HIV",
                "AIDS",
                "tuberculosis",
                "psychiatric",
                "mental health",
                "oncology",
                "biopsy",
            ),
            enforcement="redact",
            threshold=4.0,
            models=("ollama/llama3.1", "openai/gpt-4o"),
        ),
        _rule(
            "Health Record Classification",
            "Warn when HIPAA or DPDP health categories detected",
            entities=("Health Data (India-specific)",),
            keywords=("HIPAA", "PHI", "health record", "medical history"),
            enforcement="warn",
            threshold=3.0,
        ),
        _rule(
            "Patient Financial Block",
            "Block prompts containing insurance or billing PII",
            entities=("CREDIT_CARD", "IBAN_CODE", "Indian Bank Account"),
            keywords=("insurance id", "claim number", "tpa id", "cashless"),
            enforcement="redact",
            threshold=5.0,
        ),
        _rule(
            "Unapproved Model Block",
            "Only allow hospital-approved AI models",
            enforcement="block",
            threshold=0.0,
            models=("ollama/llama3.1", "openai/gpt-4o", "anthropic/claude-3-5-sonnet-20241022"),
        ),
    ],
    "IVF_CLINIC": [
        _rule(
            "Donor Identity Block",
            "Donor anonymity is legally protected. Block all donor identification attempts.",
            keywords=("donor id", "donor name", "egg donor", "sperm donor", "genetic parent", "donor profile"),
            enforcement="block",
            threshold=6.0,
        ),
        _rule(
            "Genetic Data Redact",
            "Redact genetic test results and embryo data",
            keywords=(
                "PGT",
                "PGD",
                "embryo grade",
                "karyotype",
                "chromosomal",
                "genetic report",
                "ivf cycle",
                "embryo transfer",
                "blastocyst",
            ),
            enforcement="redact",
            threshold=4.0,
        ),
        _rule(
            "Patient Identity PHI Block",
            "Block raw patient identifiers",
            entities=("PERSON", "Aadhaar Number", "Indian Mobile", "UHID (Hospital ID)"),
            enforcement="block",
            threshold=7.0,
        ),
        _rule(
            "Consent Form Handling",
            "Warn when consent form content is detected in prompts",
            keywords=("informed consent", "patient consent", "surrogacy agreement"),
            enforcement="warn",
            threshold=3.0,
        ),
        _rule(
            "Billing Data Redact",
            "Redact financial information for IVF billing",
            entities=("CREDIT_CARD", "UPI ID"),
            keywords=("cycle cost", "ivf price", "payment plan"),
            enforcement="redact",
            threshold=5.0,
        ),
    ],
    "LAW_FIRM": [
        _rule(
            "Client Identity Block",
            "Client names and matter IDs must never enter an AI model",
            entities=("PERSON", "PHONE_NUMBER", "EMAIL_ADDRESS"),
            keywords=("client name", "matter number", "case number", "file number", "client id"),
            enforcement="block",
            threshold=6.0,
        ),
        _rule(
            "Privileged Document Redact",
            "Redact privileged legal content from AI context",
            keywords=(
                "NDA",
                "non-disclosure",
                "attorney-client",
                "confidential communication",
                "legal opinion",
                "cease and desist",
                "settlement agreement",
                "litigation strategy",
                "without prejudice",
            ),
            enforcement="redact",
            threshold=4.0,
        ),
        _rule(
            "Opposing Counsel Block",
            "Block opposing party names and strategy from AI",
            keywords=("plaintiff", "defendant", "opposing counsel", "adverse party"),
            enforcement="block",
            threshold=5.0,
        ),
        _rule(
            "Financial Data Redact",
            "Redact retainer amounts and billing details",
            entities=("CREDIT_CARD", "Indian Bank Account", "UPI ID"),
            keywords=("retainer", "legal fee", "billing rate"),
            enforcement="redact",
            threshold=4.0,
        ),
        _rule(
            "Secrets Block",
            "Block API keys, passwords embedded in legal documents",
            entities=("Secret Key", "AWS Token"),
            keywords=("password", "api key", "secret", "token"),
            enforcement="block",
            threshold=3.0,
        ),
    ],
    "LOGISTICS": [
        _rule(
            "Recipient PII Block",
            "Block shipment recipient personal data",
            entities=("PERSON", "PHONE_NUMBER", "LOCATION", "Indian Mobile"),
            keywords=("recipient name", "delivery address", "consignee", "shipper name"),
            enforcement="block",
            threshold=6.0,
        ),
        _rule(
            "Shipment Data Redact",
            "Redact AWB numbers, tracking IDs, and manifest numbers",
            keywords=("awb", "tracking number", "manifest", "docket number", "pod number", "waybill"),
            enforcement="redact",
            threshold=4.0,
        ),
        _rule(
            "Payment on Delivery Redact",
            "Redact COD amounts and payment references",
            entities=("UPI ID", "CREDIT_CARD"),
            keywords=("cod amount", "payment on delivery", "upi ref"),
            enforcement="redact",
            threshold=4.0,
        ),
        _rule(
            "Customs and Import Data",
            "Warn on import/customs documentation",
            keywords=("bill of lading", "customs declaration", "harmonized code", "igst", "import permit"),
            enforcement="warn",
            threshold=2.0,
        ),
    ],
    "REAL_ESTATE": [
        _rule(
            "Buyer/Seller Identity Block",
            "Protect buyer and seller personal identifiers",
            entities=("PERSON", "Aadhaar Number", "PAN Card", "Indian Mobile"),
            keywords=("buyer name", "seller name", "purchaser", "vendor"),
            enforcement="block",
            threshold=6.0,
        ),
        _rule(
            "Property Transaction Redact",
            "Redact deal values, loan amounts, and property identifiers",
            keywords=(
                "property id",
                "survey number",
                "registration number",
                "sale deed",
                "stamp duty",
                "loan amount",
                "property valuation",
                "sale agreement",
            ),
            enforcement="redact",
            threshold=4.0,
        ),
        _rule(
            "Financial PII Redact",
            "Redact bank and payment details",
            entities=("CREDIT_CARD", "Indian Bank Account", "IBAN_CODE"),
            enforcement="redact",
            threshold=5.0,
        ),
        _rule(
            "Legal Documents Warn",
            "Warn on registered sale deed or lease agreement content",
            keywords=("registered deed", "lease agreement", "rental agreement", "encumbrance certificate"),
            enforcement="warn",
            threshold=3.0,
        ),
    ],
    "US_HEALTHCARE": [
        _rule(
            "PHI Direct Outbound Block",
            "Block any HIPAA PHI identifiers (SSN, Med Record Numbers) from leaving the network via AI.",
        ),
        _rule("SSN Masking", "Always mask Social Security Numbers."),
        _rule("Passport Identification Warning", "Flag international passport numbers for audit review."),
    ],
}


def bundled_rules() -> list[dict]:
    """The bundled rules as numbered rows."""
    rows = []
    for dept, rules in PRESETS.items():
        for rule in rules:
            rows.append({"rule_ord": len(rows) + 1, "dept": dept, "departments": [dept], **rule})
    return rows
