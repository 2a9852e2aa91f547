"""Small talk and questions about the institution, by tables of phrases and terms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A salutation, who may be addressed after it, and a question after how one is.
_HAIL = "hi|hello|hey|heya|hlo|namaste|namastey|namaskar|pranam|greetings?"
_WHOM = "there|assistant|ai|bot|ji|bhai|sir|mam"
_HOW = (
    r"how\s+(?:are\s+you|are\s+u|r\s+u|is\s+it\s+going|do\s+you\s+do|are\s+things|u\s+doing)",
    r"kya\s+haal\s+(?:hai|h|chaal)",
    r"kya\s+chal\s+raha\s+(?:hai|h)",
    r"आप\s+कैसे\s+हैं|कैसे\s+हो|क्या\s+हाल\s+है",
)
#: Classes of small talk, in order of priority, each with the phrases that may be the whole text but for blanks and marks.
SMALL_TALK: dict[str, tuple[str, ...]] = {
    "greeting_and_how_are_you": (rf"(?:{_HAIL})(?:[\s,!-]+|\s+)(?:{_WHOM})?[\s,!-]*(?:" + "|".join((*_HOW, r"kaise\s+(?:ho|hain)")) + ")",),
    "date_time": (
        r"what\s+(?:is\s+)?(?:the\s+)?(?:current\s+)?(?:date|time|day|datetime|date\s+and\s+time|today\x27?s?\s+date)",
        r"current\s+(?:date(?:\s+(?:and|&)\s+time)?|time|datetime)",
        r"today\x27?s?\s+(?:date|day)",
        r"date\s+(?:and|&)\s+time",
        r"what\s+day\s+is\s+it|what\s+time\s+is\s+it|what\s+is\s+today",
        r"aaj\s+(?:kaun\s*si|konsi|kya)\s+(?:date|tarikh|tithi)\s+(?:hai|h)",
        r"aaj\s+ki\s+(?:date|tarikh|tithi)",
        r"(?:time|samay)\s+kya\s+(?:hua\s+hai|hai|h)",
        r"aaj\s+kya\s+(?:din|vaar)\s+hai",
        r"आज\s+क्या\s+तारीख\s+है|आज\s+कौन\s*सी\s+तारीख\s+है|आज\s+क्या\s+दिन\s+है|समय\s+क्या\s+हुआ\s+है",
    ),
    "greeting": (rf"(?:{_HAIL}|namaskaar|pranaam|ram\s*ram|radhe\s*radhe|jai\s*shree\s*ram|good\s+(?:morning|afternoon|evening|day)|नमस्ते|नमस्कार|प्रणाम|राम\s*राम|राधे\s*राधे|जय\s*श्री\s*राम)(?:\s+(?:{_WHOM}))?",),
    "identity": (
        r"who\s+(?:are\s+you|are\s+u|r\s+u|developed\s+you|made\s+you|created\s+you)",
        r"what\s+(?:are\s+you|is\s+your\s+name|is\s+this\s+ai|is\s+this\s+bot|is\s+this\s+system)",
        r"introduce\s+(?:yourself|urself)|tell\s+me\s+about\s+(?:yourself|urself)",
        r"which\s+(?:university\s+are\s+you\s+for|ai\s+is\s+this|university|college)",
        r"(?:tum|aap|tu)\s+(?:kon|kaun)\s+(?:ho|hain|h|hai)",
        r"(?:kon|kaun)\s+(?:ho|hai|h)\s+(?:tum|aap|tu)",
        r"(?:tumhara|aapka|tera)\s+naam\s+kya\s+(?:hai|h)",
        r"kya\s+naam\s+(?:hai|h)\s+(?:tumhara|aapka|tera)",
        r"(?:tum|aap)\s+kya\s+(?:ho|hain|hai)",
        r"apna\s+parichay\s+(?:do|dijiye)|apne\s+ba?re\s+me(?:in)?\s+batao",
        r"तुम\s+कौन\s+हो|आप\s+कौन\s+हैं|आप\s+कौन\s+हो|तुम्हारा\s+नाम\s+क्या\s+है|आपका\s+नाम\s+क्या\s+है|अपना\s+परिचय\s+दो|अपने\s+बारे\s+में\s+बताओ",
    ),
    "help": (
        r"what\s+can\s+you\s+do|how\s+can\s+you\s+help(?:\s+me)?|what\s+do\s+you\s+do|help(?:\s+me)?|capabilities",
        r"(?:tum|aap)?\s*kya\s+kar\s+sakte\s+(?:ho|hain)",
        r"kya\s+(?:madad|help)\s+kar\s+sakte\s+(?:ho|hain)",
        r"(?:madad|help)\s+(?:karo|chahiye|dijiye)",
        r"तुम\s+क्या\s+कर\s+सकते\s+हो|आप\s+क्या\s+कर\s+सकते\s+हैं|मेरी\s+मदद\s+करो|सहायता\s+चाहिए",
    ),
    "how_are_you": (*_HOW, r"(?:aap|tum)?\s*(?:kaise|kese)\s+(?:ho|hain)", r"sab\s+(?:theek|badhiya)"),
    "joke": (r"tell\s+me\s+a\s+joke|say\s+a\s+joke|make\s+me\s+laugh|joke|koi\s+joke\s+sunao|joke\s+sunao",),
    "gratitude": (
        r"thanks?|thank\s+you(?:\s+very\s+much)?|thank\s+u|thx|tysm|ok\s+thanks?|okay\s+thanks?",
        r"dhanyawad|dhanyavaad|shukriya(?:\s+ji)?|bahut\s+(?:bahut\s+)?(?:dhanyawad|shukriya)|thanks\s+(?:bhai|ji)|thank\s+you\s+(?:bhai|ji)",
        r"धन्यवाद|शुक्रिया|बहुत\s+बहुत\s+धन्यवाद",
    ),
    "farewell": (
        r"bye|goodbye|see\s+you|cya|see\s+ya|have\s+a\s+good\s+day",
        r"alvida|phir\s+milenge|fir\s+milenge|chalta\s+hu|chalte\s+hain|bye\s+bhai",
        r"अलविदा|फिर\s+मिलेंगे",
    ),
}
#: Names of the institution and its bodies, people and papers; a code of a paper; and matters of its offices.
NAMES = [
    "mdu", "maharshi", "dayanand", "rohtak", "mdurohtak", "ucc", "dde", "uiet", "dcsa", "cdoe", "utd", "imsar", "samarth", "dms.mdu.ac.in", "mdu.ac.in",
    "yudhvir", "milap punia", "sandeep bansal", "sachdeva", "admit card", "roll no", "roll number", "datesheet", "date sheet", "gazette", "re-appear",
    "ordinance", "academic council", "executive council", "court meeting", "notification no", "prospectus", "curfew", "hostel rules", "vice chancellor",
    "vice-chancellor", "chancellor",
]
CODE = r"\b(?:[A-Za-z]{2,5}\s*[-_]?\s*[0-9]{2,4}|[0-9]{2}[A-Z]{3,6}[0-9]{2,6}[A-Z0-9]*)\b"
MATTERS = [
    "datesheet", "examination center", "exam center", "roll number slip", "re-evaluation", "rechecking", "migration certificate", "provisional degree",
    "degree verification", "affidavit", "semester result", "annual exam result", "cut-off", "cutoff", "admission portal",
]


def whole(phrases: tuple[str, ...]) -> str:
    """A pattern of texts that are one of the phrases, but for blanks and marks at their end."""
    return r"(?i)^(?:" + "|".join(phrases) + r")[\s!.,?]*$"


TERMS = "|".join(re.escape(t).replace(r"\ ", " ").replace(r"\-", "-") for t in dict.fromkeys(NAMES + MATTERS))


def small_talk(text: Column) -> Column:
    """The first class of which the stripped text is a phrase; an empty text is a greeting; null if it is none."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.coalesce(F.when(F.coalesce(t, F.lit("")) == "", "greeting"), *(F.when(t.rlike(whole(p)), k) for k, p in SMALL_TALK.items()))


def institutional(text: Column) -> Column:
    """Whether a text names the institution, a code of its papers, or a matter of its offices."""
    return F.coalesce(F.lower(text).rlike(TERMS) | text.rlike(CODE), F.lit(False))
