"""Patterns, word lists, scores and prices that results depend on.

Everything here is data. Order matters where lists say so (the first pattern that finds a span
names it).
"""

from __future__ import annotations

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
FRENCH_MONTHS = "janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre"

#: Fixed values: (type, ignore case, pattern), in order.
RULES = (
    ("email_address", True, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("email_address", False, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("phone_number", False, r"\b(\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})\b"),
    ("phone_number", False, r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("phone_number", False, r"\(\d{3}\)\s?\d{3}[-.\s]?\d{4}"),
    ("phone_number", False, r"\+\d{1,3}[-.\s]?\d{1,14}\b"),
    ("phone_number", False, r"\b0[1-9](?:[-.\s]?\d{2}){4}\b"),
    ("phone_number", False, r"\+33[-.\s]?[1-9](?:[-.\s]?\d{2}){4}\b"),
    ("social_security_number", False, r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b"),
    ("social_security_number", False, r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{3}\b"),
    ("credit_card_number", False, r"\b4\d{3}[-.\s]?\d{4}[-.\s]?\d{4}[-.\s]?\d{4}\b"),
    ("credit_card_number", False, r"\b5\d{3}[-.\s]?\d{4}[-.\s]?\d{4}[-.\s]?\d{4}\b"),
    ("credit_card_number", False, r"\b3[47]\d{2}[-.\s]?\d{6}[-.\s]?\d{5}\b"),
    ("credit_card_number", False, r"\b\d{4}[-.\s]?\d{4}[-.\s]?\d{4}[-.\s]?\d{4}\b"),
    ("date_of_birth", False, r"\b(0?[1-9]|1[0-2])/(0?[1-9]|[12]\d|3[01])/(19|20)\d{2}\b"),
    ("date_of_birth", False, r"\b(0?[1-9]|[12]\d|3[01])/(0?[1-9]|1[0-2])/(19|20)\d{2}\b"),
    ("date_of_birth", False, r"\b(19|20)\d{2}-(0?[1-9]|1[0-2])-(0?[1-9]|[12]\d|3[01])\b"),
    ("date_of_birth", False, r"\b(0?[1-9]|[12]\d|3[01])-(0?[1-9]|1[0-2])-(19|20)\d{2}\b"),
    ("date_of_birth", True, rf"\b({MONTHS})\s+(0?[1-9]|[12]\d|3[01]),?\s+(19|20)\d{{2}}\b"),
    ("date_of_birth", True, rf"\b(0?[1-9]|[12]\d|3[01])\s+({MONTHS})\s+(19|20)\d{{2}}\b"),
    ("date_of_birth", True, rf"\b(0?[1-9]|[12]\d|3[01])\s+({FRENCH_MONTHS})\s+(19|20)\d{{2}}\b"),
    ("postal_code", True, r"\b[A-Z]\d[A-Z][-.\s]?\d[A-Z]\d\b"),
    ("zip_code", False, r"\b\d{5}(-\d{4})?\b"),
    ("driver_license", False, r"\b[A-Z]\d{8}\b"),
    ("driver_license", False, r"\b\d{8,9}\b"),
    ("driver_license", False, r"\b[A-Z]{2}\d{6}\b"),
    ("ip_address", False, r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
    ("ip_address", False, r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"),
    ("url", True, r"https?://(?:[-\w.])+(?:[:\d]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:\w)*)?)?"),
    ("url", True, r"www\.(?:[-\w.])+\.(?:[a-z]{2,4})(?:[:\d]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:\w)*)?)?"),
    ("iban", False, r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}([A-Z0-9]?){0,16}\b"),
    ("medical_record_number", True, r"\bMRN[-.\s]?\d{6,10}\b"),
    ("medical_record_number", True, r"\bMR[-.\s]?\d{6,10}\b"),
    ("medical_record_number", True, r"\bpatient[-.\s]?id[-.\s]?\d{6,10}\b"),
    ("employee_id", True, r"\bEMP[-.\s]?\d{4,8}\b"),
    ("employee_id", True, r"\bemployee[-.\s]?id[-.\s]?\d{4,8}\b"),
    ("employee_id", False, r"\bE\d{4,8}\b"),
    ("person_name", False, r"\b(Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Prof\.?)\s+[A-Z][a-z]+\s+[A-Z][a-z]+\b"),
    ("person_name", False, r"\b[A-Z][a-z]{2,}\s+[A-Z][a-z]{2,}\b"),
    ("person_name", False, r"\b(M\.?|Mme\.?|Mlle\.?|Dr\.?|Prof\.?)\s+[A-Z][a-z]+\s+[A-Z][a-z]+\b"),
    ("address", True, r"\b\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Drive|Dr\.?|Lane|Ln\.?|Boulevard|Blvd\.?)\b"),
    ("address", True, r"\b\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(rue|avenue|boulevard|place|square|impasse)\b"),
)

#: What a text must hold for a rule of the type to match; only a saving of time.
RULE_NEEDS = {
    "email_address": "@", "phone_number": r"\d[-.\s]?\d{2}", "social_security_number": r"\d{3}", "credit_card_number": r"\d{4}", "date_of_birth": r"(?:19|20)\d\d",
    "driver_license": r"\d{6}", "ip_address": r"\d\.\d|[0-9a-fA-F]:[0-9a-fA-F]", "url": r"(?i)https?:|www\.", "iban": r"\d{7}", "medical_record_number": r"\d{6}",
    "employee_id": r"\d{4}", "person_name": r"[A-Z][a-z]+\s+[A-Z][a-z]", "address": r"(?i)\d\s+[a-z]", "postal_code": r"\d", "zip_code": r"\d{5}",
}
#: SQL tried before that, for types whose rules may match a text without a digit.
RULE_NEEDS_FIRST = {"ip_address": "_digit OR contains(_text, ':')", "url": "contains(_text, '.') OR contains(_text, ':')", "person_name": "true"}

#: Types that a span may have.
SPAN_TYPES = (
    "person_name", "email_address", "phone_number", "address", "date_of_birth", "social_security_number", "credit_card_number", "driver_license",
    "passport_number", "bank_account", "organization", "location", "url", "ip_address", "iban", "medical_record_number", "employee_id",
)

#: Confidence of a rule match by type.
RULE_SCORES = {
    "email_address": 0.9, "phone_number": 0.8, "social_security_number": 0.9, "credit_card_number": 0.8, "url": 0.9, "ip_address": 0.8, "iban": 0.85,
    "date_of_birth": 0.6, "person_name": 0.5, "address": 0.6, "driver_license": 0.7, "medical_record_number": 0.8, "employee_id": 0.7, "postal_code": 0.8, "zip_code": 0.8,
}
DEFAULT_RULE_SCORE = 0.7

#: Words near a span that raise its confidence.
RULE_KEYWORDS = {
    "email_address": ("email", "mail", "contact", "courriel", "@"),
    "phone_number": ("phone", "tel", "telephone", "call", "numéro", "tél"),
    "social_security_number": ("ssn", "social security", "nas", "sin"),
    "date_of_birth": ("birth", "born", "dob", "naissance", "né"),
    "person_name": ("name", "nom", "patient", "client", "employee"),
    "address": ("address", "adresse", "street", "rue", "city", "ville"),
    "credit_card_number": ("card", "credit", "carte", "payment"),
    "driver_license": ("license", "licence", "driver", "permit"),
}

#: Names that are placeholders.
PLACEHOLDER_NAMES = ("John Doe", "Jane Doe", "Test Test", "Example Example")

#: Fixed values: (dictionary, type, confidence, terms, patterns, keywords that raise the confidence).
DICTIONARIES = (
    ("healthcare_identifiers", "medical_record_number", 0.85,
     ("patient id", "patient identifier", "medical record number", "mrn", "health card", "medicare number", "hospital number", "identifiant patient", "numéro de dossier médical", "carte santé"),
     (r"patient\s*#?\s*\d{6,}", r"mrn\s*:?\s*\d{6,}", r"dossier\s*#?\s*\d{6,}"),
     ("patient", "medical", "hospital", "clinic", "doctor")),
    ("government_identifiers", "government_id", 0.9,
     ("social insurance number", "sin", "social security number", "ssn", "driver's license", "driver license", "passport number", "numéro d'assurance sociale", "nas", "permis de conduire", "numéro de passeport"),
     (r"sin\s*:?\s*\d{3}[-\s]?\d{3}[-\s]?\d{3}", r"ssn\s*:?\s*\d{3}[-\s]?\d{2}[-\s]?\d{4}", r"nas\s*:?\s*\d{3}[-\s]?\d{3}[-\s]?\d{3}"),
     ("government", "official", "issued", "identification")),
    ("financial_identifiers", "financial_account", 0.8,
     ("account number", "account #", "bank account", "credit card", "debit card", "iban", "swift", "routing number", "numéro de compte", "compte bancaire", "carte de crédit", "carte de débit"),
     (r"account\s*#?\s*:?\s*\d{8,}", r"card\s*#?\s*:?\s*\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}", r"iban\s*:?\s*[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}[A-Z0-9]{0,16}"),
     ("bank", "financial", "payment", "transaction")),
    ("employee_identifiers", "employee_id", 0.75,
     ("employee id", "employee number", "staff id", "badge number", "worker id", "personnel number", "emp id", "emp #", "identifiant employé", "numéro d'employé", "badge", "numéro de personnel"),
     (r"emp\s*#?\s*:?\s*[A-Z]?\d{4,8}", r"employee\s*#?\s*:?\s*[A-Z]?\d{4,8}", r"badge\s*#?\s*:?\s*\d{4,8}"),
     ("employee", "staff", "work", "company", "organization")),
    ("contact_identifiers", "contact_info", 0.6,
     ("phone", "telephone", "mobile", "cell", "fax", "email", "e-mail", "contact", "reach", "téléphone", "cellulaire", "courriel", "joindre"),
     (),
     ("contact", "reach", "call", "email", "phone")),
    ("education_identifiers", "student_id", 0.8,
     ("student id", "student number", "registration number", "matriculation number", "student card", "school id", "identifiant étudiant", "numéro d'étudiant", "matricule", "carte étudiante"),
     (r"student\s*#?\s*:?\s*[A-Z]?\d{6,10}", r"matricul\w*\s*:?\s*[A-Z]?\d{6,10}"),
     ("student", "school", "university", "college", "education")),
)
