"""Detection rules.

Fixed values: the patterns, scores, word lists and maps below decide the results and are
stated as the detectors define them.  ``(?U)`` gives Java's classes their Unicode meaning.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    name: str
    entity: str
    pattern: str
    score: float
    group: int = 0
    ignore_case: bool = False

    @property
    def java(self) -> str:
        return ("(?iU)" if self.ignore_case else "(?U)") + self.pattern


# Identifier, contact and date rules, in order.
REGEX_RULES = [
    Rule("aadhaar", "AADHAAR", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", 0.95),
    Rule("pan", "PAN", r"\b[A-Z]{5}\d{4}[A-Z]\b", 0.95),
    Rule("ifsc", "IFSC", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", 0.90),
    Rule("passport", "IN_PASSPORT", r"\b[A-PR-WY][1-9]\d{6}\b", 0.80),
    Rule("file", "CDSCO_FILE", r"\bCDSCO[/-][A-Z0-9/\-]{4,30}\b", 0.90),
    Rule("drug", "DRUG_ID", r"\bIND[-/ ]?\d{4,6}\b", 0.85),
    Rule("mrn", "MRN", r"\bMRN[-:\s]?\d{6,10}\b", 0.90),
    Rule("email", "EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.95),
    Rule("phone", "IN_PHONE", r"(?<!\d)(?:\+91[-\s]?|0)?[6-9]\d{9}(?!\d)", 0.90),
    Rule("phone_split", "IN_PHONE", r"(?<!\d)(?:\+91[-\s]?|0)?[6-9]\d{4}[-\s]\d{5}(?!\d)", 0.90),
    Rule(
        "address_pin",
        "ADDRESS",
        r"\b\d{1,5}[,/\-]?\s*[A-Za-z][a-z]+(?:\s+[A-Za-z][a-z]+){1,6}"
        r",\s*[A-Za-z][a-z]+(?:\s+[A-Za-z][a-z]+){0,2}"
        r"(?:,\s*[A-Za-z][a-z]+(?:\s+[A-Za-z][a-z]+){0,2})?"
        r"\s*[-–\s]?\d{6}\b",
        0.75,
    ),
    Rule("address_label", "ADDRESS", r"(?<=Address: )\d{1,5}[,/\-]?\s*[A-Za-z][\w .]+(?:,\s*[A-Za-z][\w .]+){1,5}", 0.90),
    Rule("pin", "IN_PIN_CODE", r"\b[1-9]\d{5}\b", 0.55),
    Rule("url", "URL", r"\bhttps?://[^\s<>\"']+", 0.95),
    Rule("ip", "IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.85),
    Rule("card", "CREDIT_CARD", r"\b(?:\d[ -]*?){13,16}\b", 0.50),
    Rule("date_dmy", "DATE_TIME", r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b", 0.85),
    Rule("date_ymd", "DATE_TIME", r"\b\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}\b", 0.85),
    Rule("date_month", "DATE_TIME", r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b", 0.85),
]

# Words that end a name.
_STOP = (
    r"(?!Age|Suspected|Drug|Dose|Event|Medical|History|Outcome|Reporter|"
    r"Details|Description|Gender|Address|Phone|Hospital|Email|CDSCO|"
    r"Aadhaar|Paracetamol|Aspirin|Ibuprofen|Diabetes|Mellitus|"
    r"Hypertension|Contact|Reference|Number|Report|Clinical|Serious|"
    r"Adverse|Treatment|Admitted|Since|The|His|Her|This|That)"
)
_TITLE = r"(?:Dr|Mr|Mrs|Ms|Shri|Smt|Prof|Adv)\.?\s+"
_ROLE = r"(?:Patient\s+Name|Patient|Name|Inspector|Officer|Applicant|Investigator|Sponsor|Reporter|Doctor|Physician|Nurse)"
_VERB = "developed|presented|was|had|reported|admitted|complained|visited|received|underwent|showed|experienced|suffered|died|recovered"
_VERB_OR_AGE = _VERB.replace("admitted|", "") + r"|is\s+a|aged|age"


def _name(word: str, more: str) -> str:
    return rf"({_STOP}{word}(?:\s+{_STOP}{word}){more})"


# Name rules, in order; the name is group 1.
NAME_RULES = [
    Rule("titled_name", "PERSON", _TITLE + _name("[A-Z][a-z]+", "{0,2}"), 0.85, 1),
    Rule("labelled_name", "PERSON", _ROLE + r"\s*[:\-]?\s*(?:" + _TITLE + ")?" + _name("[A-Z][a-z]+", "{0,2}"), 0.85, 1),
    Rule("narrative_name", "PERSON", r"(?:Patient|Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Shri|Smt)\s+" + _name("[A-Z][a-z]{2,}", "{0,2}") + rf"(?=\s+(?:{_VERB}))", 0.85, 1),
    Rule("context_name", "PERSON", r"\b" + _name("[A-Z][a-z]{2,}", "{1,2}") + rf"\b(?=\s+(?:{_VERB_OR_AGE}))", 0.85, 1),
]
# First words that are no names.
NAME_SKIP = (
    "Patient Name Gender Male Female Address Phone Hospital Doctor Event Drug Dose Medical History Outcome Reporter "
    "Details Description Suspected Report Diabetes The His Her This That Was Had Has"
).split()

# Organisation suffixes, known organisations and cities.
_SUFFIX = (
    r"(?:Hospital|Hospitals|Clinic|Clinics|Medical\s+(?:College|Center|Centre)|Institute|Health\s+(?:Center|Centre)|Nursing\s+Home|Pharma|"
    r"Pharmaceuticals|Laboratory|Laboratories|Labs?|Research\s+(?:Center|Centre|Institute)|Foundation)"
)
_KNOWN = (
    r"AIIMS|NIMHANS|CMC\s+Vellore|PGI\s+Chandigarh|Safdarjung|Apollo|Fortis|Max\s+Healthcare|Medanta|Manipal|Narayana\s+Health|"
    r"Lilavati|Kokilaben|Tata\s+Memorial|KIMS|Aster|Columbia\s+Asia"
)
CITIES = (
    "Mumbai|Delhi|Bangalore|Bengaluru|Chennai|Kolkata|Hyderabad|Pune|Ahmedabad|Jaipur|Lucknow|Kanpur|Nagpur|Indore|Thane|Bhopal|"
    "Visakhapatnam|Patna|Vadodara|Ghaziabad|Ludhiana|Agra|Nashik|Faridabad|Meerut|Rajkot|Kalyan|Vasai|Varanasi|Srinagar|Aurangabad|"
    r"Dhanbad|Amritsar|Navi\s+Mumbai|Allahabad|Ranchi|Howrah|Coimbatore|Jabalpur|Gwalior|Vijayawada|Jodhpur|Madurai|Raipur|Kota|"
    "Chandigarh|Guwahati|Solapur|Hubli|Tiruchirappalli|Bareilly|Moradabad|Mysore|Thiruvananthapuram|Tiruppur|Noida|Gurgaon|Gurugram|"
    r"Dehradun|Shimla|Gangtok|Imphal|Shillong|Aizawl|Kohima|Itanagar|Panaji|Daman|Silvassa|Kavaratti|Port\s+Blair|Puducherry|Pondicherry"
)
HOSPITAL_RULES = [
    Rule("hospital", "ORGANIZATION", rf"\b(?:[A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*)*\s+{_SUFFIX})\b", 0.80),
    Rule("known_hospital", "ORGANIZATION", rf"\b(?:{_KNOWN})\b", 0.80, ignore_case=True),
]
CITY_RULES = [Rule("city", "LOCATION", rf"\b(?:{CITIES})\b", 0.80)]

# Fixed values: "Label: value" rules; the value is group 1.
FIELD_RULES = [
    Rule("field_name", "PERSON", r"(?:Patient\s+)?Name\s*:\s*(.+?)(?=\n|$)", 0.95, 1, True),
    Rule("field_doctor", "PERSON", r"(?:Doctor|Physician|Treating\s+Doctor)\s*:\s*(.+?)(?=\n|$)", 0.95, 1, True),
    Rule("field_hospital", "ORGANIZATION", r"Hospital\s*:\s*(.+?)(?=\n|$)", 0.95, 1, True),
    Rule("field_address", "ADDRESS", r"Address\s*:\s*(.+?)(?=\n|$)", 0.95, 1, True),
    Rule("field_phone", "IN_PHONE", r"Phone(?:\s+number)?\s*:\s*(.+?)(?=\n|$)", 0.95, 1, True),
    Rule("field_aadhaar", "AADHAAR", r"Aadhaar(?:\s+Number)?\s*:\s*(.+?)(?=\n|$)", 0.95, 1, True),
    Rule("field_email", "EMAIL_ADDRESS", r"Email\s*:\s*(.+?)(?=\n|$)", 0.95, 1, True),
    Rule("field_reporter", "PERSON", r"Reporter\s*:\s*(.+?)(?=\n|$)", 0.95, 1, True),
]
INLINE_RULES = [
    Rule("inline_patient", "PERSON", r"\bPatient\s+([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,}){0,2})\b", 0.92, 1),
    Rule("inline_title", "PERSON", r"\b(?:Dr|Mr|Mrs|Ms|Shri|Smt)\.?\s+([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,}){0,2})\b", 0.92, 1),
]
INLINE_SKIP = "Paracetamol Aspirin Ibuprofen Diabetes Mellitus Hypertension The His Her".split()
SPACED_LETTERS = r"\b(?:[A-Z] ){2,}[A-Z]\b"

# Words that a model wrongly tags, and short names of organisations.
NER_FALSE = (
    "patient gender male female address phone hospital doctor event drug dose medical history outcome reporter details description suspected "
    "report diabetes mellitus hypertension paracetamol aspirin ibuprofen icu opd ipd sae serious adverse name email age cdsco reference aadhaar "
    "pan kumar treatment admission clinical number twice daily days since severe after"
).split()
SHORT_ORGS = ["AIIMS", "NIMHANS", "KIMS", "PGI", "CMC", "ICU"]

# Token prefixes.
TOKEN_PREFIX = {
    "PERSON": "PER", "PHONE_NUMBER": "PHN", "IN_PHONE": "PHN", "AADHAAR": "UID", "EMAIL_ADDRESS": "EML", "ADDRESS": "ADR",
    "ORGANIZATION": "ORG", "LOCATION": "LOC", "GPE": "LOC", "PAN": "PAN", "DATE_TIME": "DAT", "IN_PASSPORT": "PSP", "IFSC": "IFS",
    "MRN": "MRN", "DRUG_ID": "DRG", "CDSCO_FILE": "CDS", "URL": "URL", "IP_ADDRESS": "IPA", "CREDIT_CARD": "CCN", "IN_PIN_CODE": "PIN", "NRP": "NRP",
}

# The 18 categories and what maps to them.
HIPAA_CATEGORIES = (
    "NAMES GEOGRAPHIC_DATA DATES PHONE_NUMBERS FAX_NUMBERS EMAIL_ADDRESSES SSN MRN HEALTH_PLAN_BENEFICIARY ACCOUNT_NUMBERS LICENSE_NUMBERS "
    "VEHICLE_IDS DEVICE_IDS URLS IP_ADDRESSES BIOMETRIC_IDS FACE_PHOTOS OTHER_UNIQUE_IDS"
).split()
HIPAA_OF = {
    "PERSON": "NAMES", "EMAIL_ADDRESS": "EMAIL_ADDRESSES", "IN_PHONE": "PHONE_NUMBERS", "URL": "URLS", "IP_ADDRESS": "IP_ADDRESSES",
    "DATE_TIME": "DATES", "MRN": "MRN", "ADDRESS": "GEOGRAPHIC_DATA", "LOCATION": "GEOGRAPHIC_DATA", "IN_PIN_CODE": "GEOGRAPHIC_DATA",
    "IN_PASSPORT": "LICENSE_NUMBERS", "CREDIT_CARD": "ACCOUNT_NUMBERS", "IFSC": "ACCOUNT_NUMBERS", "AADHAAR": "OTHER_UNIQUE_IDS",
    "PAN": "OTHER_UNIQUE_IDS", "DRUG_ID": "OTHER_UNIQUE_IDS", "CDSCO_FILE": "OTHER_UNIQUE_IDS", "ORGANIZATION": "OTHER_UNIQUE_IDS",
}
