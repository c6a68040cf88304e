"""Text screens: one pattern each, run over a whole line."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from payproof import schema as S
from payproof.functions.money import parse_amount
from payproof.functions.text import let, strip

# --- fixed values: patterns for expense and bank wording ----------------------
NON_SUPPLIER_PHRASES = (
    r"\b(bank (?:charges?|fees?)|account (?:fees?|charges?)|service charges?|overdraft|interest (?:charges?|paid)|"
    r"payroll|salar(?:y|ies)|wages|irs|eftps|hmrc|paye|vat (?:payment|return)|(?:federal|sales|corporation|payroll) tax|"
    r"tax payment|(?:card|amex|visa|mastercard) settlement|amex card|credit card payment|"
    r"transfer to (?:own|our|savings|deposit|reserve)\b|own account|internal transfer|savings acc(?:oun)?t|"
    r"loan (?:repayment|payment|instal?ments?)|(?:wire|merchant|card|transaction|processing|stripe|paypal) fees?|"
    r"amex (?:e-?payment|payment)|state tax|tax board|franchise tax|^\s*interest(?=\s*(?:$|\d|charge|paid|debit))|"
    r"interest (?:debit|charged))\b(?!\s+(?:partners|ltd|limited|inc|llc|group|media|consulting|services))")
NON_SUPPLIER_BANK = "(?iU)" + NON_SUPPLIER_PHRASES
PERSONAL = r"(?iU)\b(gym|membership|personal(?! protective)|netflix|spa|haircut|for myself)\b"
PROFESSIONAL = (r"(?iU)\b(society|institute|association|professional|licen[cs]e|certif\w*|chamber|cpa|cima|acca|"
                r"bar council|union dues)\b")
TRAVEL = r"(?iU)\b(travel|trip|flight|hotel|conference|client site|airport|mileage)\b"
TRAVEL_SPEND = r"(?iU)\b(taxi|meal|hotel|travel|mileage|parking|fuel|train|airfare)\b"
TRIP_CATEGORY = r"(?iU)\b(travel|airfare|hotel)\b"
BATCH_WORDING = r"(?iU)\b(bacs|batch|bulk|payment run|pay run|ach|multiple payments)\b"
NO_RECEIPT_KINDS = r"(?iU)\b(mileage|per ?diem|allowance|subsistence)\b"
REMIT_TO = r"(?i)remit[ -]?to"
HEADCOUNT_IN_NOTES = (r"(?iU)\b(\d{1,3}|" + "|".join(S.NUMBER_WORDS)
                      + r")\s*(people|persons|guests|pax|attendees|diners)|\((\d{1,2})\)")

# --- fixed values: wording that addresses an automated reviewer ---------------
_WHO = (r"(?:ai|a\.i\.|llm|gpt|chat\s*bot|chatbot|bot|model|language\s+model|assistant|auditor|reviewer|agent|"
        r"skeptic|system)")
AI_PHRASES = [
    rf"\b(?:note|notice|message|memo|instructions?|attention|attn|reminder)\s*(?:to|for)\s*(?:the\s+|any\s+|all\s+)?"
    rf"(?:\w+\s+)?{_WHO}s?\b",
    rf"\b(?:dear|hey|hello|hi)\s+(?:\w+\s+)?{_WHO}\b",
    r"\b(?:ai|llm|gpt|chatbot|assistant|skeptic)\s+(?:auditor|reviewer|agent|model|assistant|checker)s?\b",
    r"\b(?:ignore|disregard|forget|override)\s+(?:all\s+|any\s+|the\s+|your\s+|these\s+)*"
    r"(?:previous|prior|above|earlier|preceding|other|system|policy|policies|instructions?|rules?|prompts?|clauses?)\b",
    r"\bmark(?:ed)?\s+(?:this|it|the\s+\w+|this\s+\w+)?\s*(?:line\s+|finding\s+|payment\s+|invoice\s+)?as\s+"
    r"(?:not\b|no\b|ok\b|okay|fine|clean|compliant|approved|confirmed|doubtful|resolved|valid|legit|false|cleared|safe|a\s+false)",
    r"\bverdicts?\b",
    r"\b(?:answer|respond|reply|output|return|say)\s+(?:only\s+|with\s+|just\s+)*[\"']?(?:confirmed|doubtful)\b",
    r"\b(?:you\s+are\s+now|you\s+must\s+(?:answer|reply|respond|ignore|mark|treat)|as\s+an\s+ai\b|act\s+as\b)",
    r"\b(?:not\s+a\s+(?:problem|breach|finding)\s+for\s+(?:the\s+)?(?:ai|audit|review))",
    r"(?:^|[\s,;|\"'\[(])(?:system|assistant|developer)\s*:",
    r"<\|?/?\s*(?:system|assistant|user|im_start|im_end|endoftext)\s*\|?>|\[/?(?:inst|sys)\]|<</?sys>>",
    r"\bprompt\s+injection\b|\bjailbreak\b",
]
AI_TEXT = "(?iU)" + "|".join(AI_PHRASES)

# --- fixed values: a reason that affirms or denies a breach -------------------
AFFIRM_PHRASES = r"\b(clearly|directly|plainly|explicitly|does)\s+(breach|violat|exceed)|\bis a (clear )?breach\b"
DENY_NEGATIONS = (r"\b(?:does not|doesn't|did not|didn't|do not|don't|cannot|can't|isn't|is not|was not|wasn't|not|no|never)\s+"
                  r"(?:clearly\s+|really\s+|actually\s+|necessarily\s+|seem\s+to\s+|appear\s+to\s+)?"
                  r"(?:an?\s+|any\s+)?(?:clear\s+|real\s+|actual\s+)?(?:breach|violat|exceed)")
DENY_PHRASES = r"(?<!\bmust )(?<!\bmay )(?<!\bshould )(?<!\bshall )" + DENY_NEGATIONS


def non_supplier_bank(description: Column, reference: Column) -> Column:
    return F.concat(description, F.lit(" "), reference).rlike(NON_SUPPLIER_BANK)


def is_batch(description: Column, reference: Column) -> Column:
    return F.concat(description, F.lit(" "), reference).rlike(BATCH_WORDING)


def ai_text(line: Column) -> Column:
    return F.coalesce(line.rlike(AI_TEXT), F.lit(False))


def contradicts(verdict: Column, reason: Column) -> Column:
    """A verdict that disagrees with the reason given for it."""
    affirms, denies = reason.rlike("(?iU)" + AFFIRM_PHRASES), reason.rlike("(?iU)" + DENY_PHRASES)
    return F.when(verdict == "Doubtful", affirms & ~denies).otherwise(denies & ~affirms)


def head_count(c: Column) -> Column:
    """'4', '4.0' or 'four'; anything else, or a number outside 1-200, is unknown and reads 0."""
    words = F.array(*[F.lit(w) for w in S.NUMBER_WORDS])

    def count(t: Column) -> Column:
        def whole(n: Column) -> Column:
            return F.when((n == F.floor(n)) & (n > 0) & (n <= 200), n.cast("int")).otherwise(F.lit(0))
        word = F.array_position(words, t)
        return F.when(word > 0, word.cast("int")).otherwise(let(parse_amount(t), whole))
    return let(F.lower(strip(c)), count)


def people_of(people: Column, notes: Column) -> Column:
    """The head count of a meal: its own column, else what the notes say ('Team dinner - 5 people')."""
    noted = F.concat(F.regexp_extract(notes, HEADCOUNT_IN_NOTES, 1), F.regexp_extract(notes, HEADCOUNT_IN_NOTES, 3))
    return let(head_count(people), lambda said: F.when(said > 0, said).otherwise(head_count(noted)))


def receipt_of(ref: Column) -> Column:
    """The receipt reference, blank when the cell only says there is none."""
    t = strip(ref)
    return F.when(F.upper(t).isin(S.NO_RECEIPT), F.lit("")).otherwise(t)
