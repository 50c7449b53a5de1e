"""Rule engine: signals with evidence spans, categories, actions, label policies, scores.

Spans are code point offsets into the original text, so they are found in Python, batch by batch. A
rule is searched only in texts that contain one of its literals, all of which one pass looks up.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .prefilter import Prefilter
from .text import bound

# Rules in their order of evaluation.
WEB_TLDS = (
    "ae|ai|app|ar|au|bank|bd|be|biz|br|bw|bz|ca|cc|ch|cl|click|cloud|cn|co|com|de|"
    "dev|email|es|example|finance|fr|ga|gg|gl|gr|gs|help|hu|icu|id|in|info|io|it|jp|"
    "kr|lc|life|link|live|lv|ly|me|ml|mobi|mx|net|news|nl|no|nz|online|org|ph|pk|pl|"
    "pro|pt|pw|ro|ru|se|sg|shop|site|st|store|su|support|tech|tk|to|today|top|tr|tv|"
    "ty|uk|us|vg|vip|website|work|world|ws|xy|xyz|za"
)
RULES = {
    "artificial_urgency": r"\b(?:act now|immediately|urgent|within \d+ hours?|final notice|final chance|last chance|today only|urgente|inmediatamente|immédiatement|dringend|onmiddellijk|sofort|immediatamente|imediatamente)\b",
    "authority_impersonation": r"\b(?:irs|police|court|customs|government|tax department|fbi|cbi|fraud desk|customer care|fedex|apple pay|paytm|westpac|hdfc|anz)\b",
    "credential_request": r"\b(?:password|login details?|log in|sign in|credentials?|personal details?|bank(?:ing)? details?|routing details?|salary account|social security|account info(?:rmation)?|billing address|email address|authentication information|seed phrase|recovery phrase|pan card|kyc|photo id|contraseña|mot de passe|wachtwoord|passwort|senha|c[oó]digo de verificaci[oó]n|code de vérification|verificatiecode)\b",
    "otp_request": r"\b(?:otp|one[- ]time (?:code|password)|verification code|mfa code|\d+[- ]digit code)\b",
    "payment_request": r"\b(?:pay|payment|transfer|send|process|settle|deposit|buy|use|return)\b.{0,50}(?:\$|£|€|usd|bdt|taka|inr|rs\.?|dollars?|fee|money|funds?|invoice|account|gift cards?|crypto(?:currency)?|equipment|charge|toll|payment app)",
    "unusual_payment_method": r"\b(?:gift cards?|bitcoin|crypto(?:currency)?|wire transfer|western union|moneygram)\b",
    "shortened_url": r"\b(?:bit\.ly|tinyurl\.com|t\.co|is\.gd|rb\.gy)/\S+",
    "suspicious_link": r"<URL>|(?:\bhttps?\s*:\s*/{0,2}|\bhtt\s*ps?\s*:\s*/{0,2}|\bwww\.)[^\s<>]+|"
    rf"\b[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.(?:{WEB_TLDS})(?:/[^\s<>]*)?|\b[a-z0-9-]+\[\.\](?:{WEB_TLDS})(?:/[^\s<>]*)?|"
    r"\b(?:click|tap|open|follow|visit|track).{0,24}\b(?:link|here)\b|\b(?:haga clic aqu[ií]|clique aqui|clique ici|klik hier|klicken sie hier|lien ci-dessous)\b|\bdownload\b.{0,40}\.apk\b",
    "contact_diversion": r"<PHONE_NUMBER>|<US_BANK_NUMBER>|\b(?:call|dial|text|contact|reply|calnumber)\b.{0,45}(?:this number|below number|whatsapp|telegram|freefone|freephone|customer care|live operator|\+?\d[\d *#-]{5,})|\b\+?\d[\d *#-]{6,}\d\b|\bcontact now\b",
    "secrecy_isolation": r"\b(?:do not tell|keep this secret|don't tell|between us|do not contact)\b",
    "guaranteed_return": r"\b(?:guaranteed|risk[- ]free)\b.{0,25}\b(?:profits?|returns?|income|investment)\b",
    "advance_fee": r"\b(?:processing|release|activation|customs|clearance|application|onboarding|recovery|refundable)\s+(?:fee|bond)\b",
    "remote_access_request": r"\b(?:anydesk|teamviewer|remote desktop|remote support|screen sharing|remote access)\b",
    "threat_or_coercion": r"\b(?:arrest|warrant|legal action|disconnect(?:ed|ion)?|(?:account|atm|card|wallet|paytm|access).{0,35}(?:closed|suspended|block(?:ed)?|locked|frozen|de-?activated|restricted)|account hacked|failed login|temporarily disabled|expired identity|restore access|storage reached|suspendid[ao]|bloquead[ao]|gesperrt|geblokkeerd|bloqu[eé]e?|sospes[ao]|disattivat[ao])\b",
    "trust_acceleration": r"\b(?:soulmate|destiny|trust me|only you understand|future together)\b",
    "too_good_to_be_true": r"\b(?:winner|won|prize|lottery|free money|selected to receive|reward|awarded|lucky draw|free gift|await collection|gained the sum|entitled to|shopping spree|discount vouchers?|cashback|bonus|giveaway|eligible to claim|free smartphone|free mobile|double (?:your )?(?:money|investment)|earn .{0,16} per day)\b|(?:জিতেছেন|পুরস্কার|লটারি|বোনাস|ভাউচার)",
    "off_platform_request": r"\b(?:move|continue|message me)\b.{0,30}\b(?:telegram|whatsapp|signal)\b",
}
CATEGORY_WORDS = (
    ("DELIVERY_TOLL_PARKING", ("package", "parcel", "delivery", "toll", "parking")),
    ("CREDENTIAL_MFA", ("password", "otp", "verification code", "digit code", "fraud desk", "login", "sign in", "mailbox session", "mfa")),
    ("GOVERNMENT_LEGAL", ("irs", "police", "court", "customs", "government", "tax", "detective", "warrant", "station")),
    ("TECH_SUPPORT", ("tech support", "microsoft support", "virus", "anydesk", "teamviewer")),
    ("JOB_OPPORTUNITY", ("job", "recruiter", "hiring", "hired", "work from home", "interview", "onboarding fee", "position")),
    ("FAMILY_EXECUTIVE", ("mom", "mum", "dad", "auntie", "grandpa", "son", "daughter", "ceo", "boss", "board meeting", "approve the paperwork", "temporary number", "phone broke")),
    ("ROMANCE_RELATIONSHIP", ("romance", "soulmate", "future together", "planning our future", "love", "inheritance", "only you")),
    ("INVESTMENT_CRYPTO", ("investment", "bitcoin", "crypto", "guaranteed return", "forex")),
    ("PRIZE_LOTTERY", ("winner", "prize", "lottery", "sweepstakes")),
    ("MARKETPLACE", ("marketplace", "buyer", "seller", "shipping agent", "listing")),
    ("PAYMENT_INVOICE", ("invoice", "payment", "wire transfer")),
    ("FINANCIAL_IMPERSONATION", ("bank", "card", "account frozen", "fraud department", "payroll", "routing details", "direct-deposit", "salary account")),
    ("CHARITY", ("charity", "donation", "fundraiser")),
)
DATASET_CATEGORY_WORDS = (
    ("CREDENTIAL_THEFT", ("password", "otp", "verification code", "sign-in")), ("DELIVERY_TOLL", ("parcel", "delivery", "toll", "shipping")),
    ("OPPORTUNITY", ("job", "hired", "earn", "work from home")), ("FINANCIAL", ("bank", "payment", "loan", "investment", "refund")),
)
STRONG = (
    "advance_fee", "contact_diversion", "credential_request", "guaranteed_return", "off_platform_request", "otp_request", "remote_access_request",
    "secrecy_isolation", "shortened_url", "suspicious_link", "threat_or_coercion", "too_good_to_be_true", "trust_acceleration", "unusual_payment_method",
)
SPECIFIC = ("otp_request", "unusual_payment_method", "remote_access_request", "guaranteed_return", "advance_fee", "secrecy_isolation")
GUIDANCE = (
    r"(?iU)\b(?:beware of (?:fraud|scams?)|scam alert|fraud awareness|avoid scams?|protect yourself|do not share|don['’]t share|never share|never asks?|will never ask|will never call|does not ask|report (?:it|them|scams?)|"
    r"no compart(?:as|a)|nunca (?:te |le )?pedir[áa]|cuidado con (?:las )?estafas|ne partagez jamais|ne (?:vous )?demandera jamais|attention aux arnaques|niemals weitergeben|nicht weitergeben|wird (?:sie )?niemals fragen|vorsicht vor betrug|"
    r"deel\w* nooit|nooit delen|zal nooit vragen|non condividere|non chieder[àa] mai|attenzione alle truffe|n[ãa]o compartilhe|nunca pedir[áa]|cuidado com golpes|jangan bagikan|tidak akan pernah meminta|waspada penipuan|if (?:this|it|that) (?:is|was) not you)\b"
)
AUTH_CODE = r"(?iU)\b(?:otp|one[- ]time (?:pin|password|code)|authentication code|verification code|login code|sign[- ]in code|security code|\btac\b)\b"
EXTERNAL_ACTION = r"(?iU)\b(?:click|visit|open|follow|tap|update|verify|confirm|activate|restore|log ?in|sign ?in)\b.{0,100}(?:<URL>|https?://|www\.|\[\.\]|\b(?:link|here)\b)"
LOW_RISK_OFFER = r"(?iU)\b(?:advert|offer|promotion|sale|discount|subscription|free trial|mobile plan|holiday|vacation|property|plot allotment|homeowners?|tenants?|loan for|compensation up to|study participants?|upgrade|latest (?:phone|mobile)|line ?rental|shop(?:ping)?|tickets? for sale)\b"
BLOCKED_CHECK = r"(?iU)\b(?:do not|don't|don’t|cannot|can't|can’t|must not)\s+(?:try\s+to\s+)?(?:call|contact|verify|check|ring)\b"
TRUSTED_CHANNEL = (
    r"(?iU)(?:official app|aplicaci[oó]n oficial|application officielle|offizielle app|offici[eë]le app|app ufficiale|aplica[cç][aã]o oficial|aplikasi resmi|number (?:on|printed on) (?:your|the) card|"
    r"n[uú]mero (?:de|en|que figura en) (?:tu |la )?tarjeta|num[eé]ro (?:sur|figurant sur) (?:votre |la )?carte|nummer (?:auf|op) (?:ihrer|uw|de) (?:karte|kaart)|numero (?:sulla|riportato sulla) carta|"
    r"n[uú]mero (?:no|indicado no) cart[aã]o|nomor (?:pada|yang tertera pada) kartu|number you already have|saved contact|known contact|regular call|normal contact)"
)
EXPLICIT_SAFETY = (
    r"(?iU)(?:before sending anything|never (?:ask|asks|request|requests) (?:you )?(?:for )?(?:a )?code|no link|asks? for no credentials|not requesting money|nunca (?:te )?pediremos un c[oó]digo|nunca pediremos um c[oó]digo|"
    r"ne demanderons jamais de code|fragen nie nach einem code|vragen nooit om een code|non chiederemo mai un codice|tidak akan pernah meminta kode)"
)
MATCH_TYPE = "array<struct<signal:string,text:string,start:int,end:int>>"

_COMPILED = [(name, re.compile(pattern, re.I)) for name, pattern in RULES.items()]
_SKIPPED = re.compile(r"​|(?<=\s)[.:;|](?=\s)")
_MARKS = frozenset(".:;|")
_MAY_MATCH: list[Prefilter] = []


def _may_match() -> Prefilter:
    if not _MAY_MATCH:
        _MAY_MATCH.append(Prefilter(RULES))
    return _MAY_MATCH[0]


def plain(text: str) -> str:
    """The text without zero-width spaces and lone separators, and with spaces collapsed."""
    parts = text.split()
    if "​" in text or not _MARKS.isdisjoint(parts):
        text = _SKIPPED.sub("", text)
        parts = text.split()
    if not parts:
        return " " if text else ""
    return " " * text[0].isspace() + " ".join(parts) + " " * text[-1].isspace()


def kept_places(text: str) -> list[int]:
    """The place in the text of each character of ``plain(text)``."""
    places, at = [], 0
    for m in _SKIPPED.finditer(text):
        places.extend(range(at, m.start()))
        at = m.end()
    places.extend(range(at, len(text)))
    spaces = [text[i].isspace() for i in places]
    return [i for n, i in enumerate(places) if not (n and spaces[n] and spaces[n - 1])]


def matches(text: str | None) -> list[dict]:
    """First match of each rule, with its span in the original text."""
    text = text or ""
    searched = plain(text)
    may = _may_match()(searched)
    found = [(name, m) for name, pattern in _COMPILED if name in may and (m := pattern.search(searched))]
    places = kept_places(text) if found else []
    spans = [(name, places[m.start()], places[m.end() - 1] + 1) for name, m in found]
    return [{"signal": name, "text": text[a:b], "start": a, "end": b} for name, a, b in spans]


def signal_matches(text: Column) -> Column:
    @F.pandas_udf(MATCH_TYPE)
    def find(values: pd.Series) -> pd.Series:
        return values.map(matches)

    return find(text)


def signal_flags(text: Column) -> dict[str, Column]:
    """One boolean per rule, from one call: for counts and filters that need no spans."""

    @F.pandas_udf("array<string>")
    def find(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [m["signal"] for m in matches(v)])

    found = find(text)
    return {name: F.array_contains(found, name) for name in RULES}


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def _first_of(text: Column, categories: tuple, none: Column) -> Column:
    """The first category of which the text has a word."""
    out = none
    for name, words in reversed(categories):
        out = F.when(_any_word(text, words), name).otherwise(out)
    return out


#: Characters whose case folding has ASCII letters that lower case does not give.
FOLDS = (("ſ", "s"), ("ß", "ss"), ("ẞ", "ss"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))


def folded_letters(text: Column) -> Column:
    """Lower case, with all ASCII letters that case folding gives."""

    def spelt(t: Column) -> Column:
        out = t
        for c, letters in FOLDS:
            out = F.replace(out, F.lit(c), F.lit(letters))
        return F.when(t.rlike("[" + "".join(c for c, _ in FOLDS) + "]"), out).otherwise(t)

    return bound(F.lower(text), spelt)


def infer_category(text: Column, signals: Column) -> Column:
    none = F.when(F.size(signals) > 0, "OTHER_SCAM").otherwise("UNKNOWN")
    return bound(folded_letters(text), lambda t: _first_of(t, CATEGORY_WORDS, none))


def dataset_category(text: Column) -> Column:
    return bound(F.lower(text), lambda t: _first_of(t, DATASET_CATEGORY_WORDS, F.lit("UNKNOWN")))


def any_of(signals: Column, names: tuple[str, ...] | list[str]) -> Column:
    return F.arrays_overlap(signals, F.array(*map(F.lit, names)))


def within(signals: Column, names: tuple[str, ...] | list[str]) -> Column:
    return F.size(F.array_except(signals, F.array(*map(F.lit, names)))) == 0


def choose_action(signals: Column) -> Column:
    steps = (
        (("otp_request", "credential_request"), "DO_NOT_SHARE_CODE"), (("remote_access_request",), "DO_NOT_INSTALL_SOFTWARE"),
        (("unusual_payment_method", "payment_request"), "DO_NOT_PAY"), (("suspicious_link", "shortened_url"), "DO_NOT_OPEN_LINK"),
    )
    out = F.when(F.size(signals) > 0, "VERIFY_OFFICIAL_CHANNEL").otherwise("NO_ACTION")
    for names, action in reversed(steps):
        out = F.when(any_of(signals, names), action).otherwise(out)
    return out


def _policy(label: str, reason: str) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(reason).alias("policy"))


def protective_label(text: Column, signals: Column) -> Column:
    """Guidance against scams, or a bare authentication notice; null for all other texts."""
    diverts = text.rlike(EXTERNAL_ACTION) | F.array_contains(signals, "contact_diversion")
    bare = text.rlike(AUTH_CODE) & within(signals, ("authority_impersonation", "credential_request", "otp_request"))
    return (
        F.when(text.rlike(GUIDANCE) & diverts, _policy("UNCERTAIN", "defensive_guidance_with_external_action"))
        .when(text.rlike(GUIDANCE), _policy("SAFE", "defensive_guidance"))
        .when(bare, _policy("SAFE", "standalone_authentication_notification"))
    )


def strong_evidence(signals: Column) -> Column:
    return any_of(signals, STRONG)


def sms_label(text: Column, signals: Column, source_label: Column) -> Column:
    """Label and policy of a short-message corpus; null for unknown source labels."""
    offer = text.rlike(LOW_RISK_OFFER) & within(signals, ("artificial_urgency", "contact_diversion", "payment_request", "suspicious_link"))
    smishing = F.coalesce(
        protective_label(text, signals),
        F.when(offer, _policy("UNCERTAIN", "commercial_offer_without_clear_fraud"))
        .when(strong_evidence(signals), _policy("SCAM", "source_smishing_with_strong_text_evidence"))
        .otherwise(_policy("UNCERTAIN", "source_smishing_without_strong_text_evidence")),
    )
    return (
        F.when(source_label == "ham", _policy("SAFE", "source_ham"))
        .when(source_label == "spam", _policy("UNCERTAIN", "source_generic_spam"))
        .when(source_label == "smishing", smishing)
    )


def forum_label(text: Column, signals: Column, source_label: Column) -> Column:
    strong = strong_evidence(signals)
    return F.coalesce(
        protective_label(text, signals),
        F.when(source_label == "spam", _policy("UNCERTAIN", "source_generic_spam"))
        .when((source_label == "wrong number") & ~strong, _policy("UNCERTAIN", "wrong_number_without_message_evidence"))
        .when(strong, _policy("SCAM", "source_reported_smishing_with_strong_text_evidence"))
        .otherwise(_policy("UNCERTAIN", "source_reported_without_strong_text_evidence")),
    )


def override(text: Column, signals: Column) -> Column:
    """A verdict by rule: a blocked check with a credential request, or guidance to a trusted channel."""
    blockers = [n for n in RULES if n not in ("authority_impersonation", "payment_request")]
    rule = lambda v, r: F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule"))
    trusted = text.rlike(TRUSTED_CHANNEL) & ~any_of(signals, blockers)
    settled = ~F.array_contains(signals, "payment_request") | text.rlike(EXPLICIT_SAFETY)
    return (
        F.when(F.array_contains(signals, "credential_request") & text.rlike(BLOCKED_CHECK), rule("SCAM", "blocked_verification_with_credential_request"))
        .when(trusted & settled, rule("SAFE", "explicit_trusted_channel_guidance"))
    )


def heuristic_scores(signals: Column) -> Column:
    """Three probabilities from the number and kind of signals; a stand-in, not a model."""
    n = F.size(signals)
    specific = F.size(F.array_intersect(signals, F.array(*map(F.lit, SPECIFIC))))
    score = F.lit(0.05) + F.least(F.lit(0.30), n * 0.08) + F.least(F.lit(0.54), specific * 0.27)
    both = F.array_contains(signals, "suspicious_link") & F.array_contains(signals, "artificial_urgency")
    scam = F.least(score + F.when(both, 0.18).otherwise(0.0), F.lit(0.98))
    uncertain = F.least(F.lit(0.65), n * 0.08 + 0.08)
    safe = F.greatest(F.lit(0.0), 1 - scam - uncertain)
    total = safe + uncertain + scam
    return F.struct((safe / total).alias("p_safe"), (uncertain / total).alias("p_uncertain"), (scam / total).alias("p_scam"))
