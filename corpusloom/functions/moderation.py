"""Tagging by rule tables: the first category that fits, by priority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import evasion_folded, evasion_squashed

#: Patterns by category, in order of priority; texts come folded, case does not count. Any table of this form
#: can be passed instead.
PATTERNS = {
    "PROFANITY_ABUSE": [
        r"\b(b\.?c\.?|b\*c|bhenchod|behenchod|bhen\s*chod|behen\s*chod|bhenke\s*lode|bhenchodd)\b",
        r"\b(m\.?c\.?|m\*c|madarchod|madar\s*chod|maarchod|madarchodd)\b",
        r"\b(bhosdike|bhosadi|bhosadike|bhosdi|bhosdk|bhosd|bsdk|b\.?s\.?d\.?k)\b",
        r"\b(chutiya|chutiye|chutye|chootiya|chut\*ya|ch\*tiya|chutiyapa)\b",
        r"\b(gandu|gaand|g@ndu|gandwa|gandfat|gandmasti)\b",
        r"\b(lauda|loda|lode|laude|l0da|laude\s*lag\s*gaye)\b",
        r"\b(harami|haramkhor|haramzada|haramzade)\b",
        r"\b(randi|rand|randi\s*rona|raand)\b",
        r"\b(kamine|kamina|kaminey|kutti\s*kamini)\b",
        r"\b(saale|saali|bhadwe|bhadwa|chhed|chodu)\b",
        r"\b(teri\s*maa\s*ki|maa\s*ki\s*chut|tere\s*baap\s*ka)\b",
        "(बहनचोद|मादरचोद|भोस[डड़\u093c]*ीके?|भोस[डड़\u093c]*ी|चूतिया|गांडू|हरामी|हराम[जज़\u093c]*ादा|लौ[डड़\u093c]*ा|लवड़े|रंडी|कमीने|साले|भा[डड़\u093c]*वे)",
        r"\b(f+u+c+k|f\*ck|f\*\*k|fucking|fucker|motherfucker|mf)\b",
        r"\b(b+i+t+c+h|b\*tch|b!tch|bitches)\b",
        r"\b(a+s+s+h+o+l+e|a\*\*hole|dumbass|jackass)\b",
        r"\b(b+a+s+t+a+r+d|bastards)\b",
        r"\b(c+u+n+t|d+i+c+k|p+u+s+s+y|d+i+l+d+o)\b",
        r"\b(w+h+o+r+e|s+l+u+t|f+a+g+g+o+t|r+e+t+a+r+d)\b",
        r"\b(go\s+die|kill\s+yourself|kys)\b",
    ],
    "HATE_SPEECH_COMMUNAL": [
        r"\b(bhangi|chamar|chura|neech\s*jaati|achhut|chandal)\b",
        r"\b(dange\s*karwao|rioting|burn\s*the\s*temple|burn\s*the\s*mosque|kill\s*all\s*(hindus|muslims|sikhs|christians))\b",
        r"\b(terrorist\s*(religion|community)|jihadi\s*dog|kafir\s*maro)\b",
    ],
    "ADVERSARIAL_TEACHING": [
        r"\b(learn\s+that|remember\s+that|accept\s+as\s+(a\s+)?fact|believe\s+that|update\s+your\s+knowledge)\b.*\b(cheating|cheat|allowed|fake|corrupt|briber?y?|bribes?|paying\s+bribes?|illegal|hack|hacked)\b",
        r"\b(from\s+now\s+on\s+you\s+(believe|think|must\s+say|will\s+teach|answer))\b",
        r"\b(i\s+am\s+(teaching|educating|programming|reprogramming)\s+you\s+that)\b",
        r"\b(forget\s+(what\s+)?(university|ugc|mdu|management|rules|guidelines)\s+(said|stated|told))\b",
        r"\b(tumhe\s+(sikhna|yaad\s*rakhna|maanna)\s+hoga\s+ki)\b",
        r"\b(aaj\s+se\s+(tum\s+)?(yeh\s+)?(maanoge|sikhoge|bologe)\s+ki)\b",
        r"\b(ab\s+se\s+tumhara\s+naya\s+rule\s+hai)\b",
        r"\b(tujhe\s+mai\s+sikha\s+raha\s+hu)\b",
        r"\b(adopt\s+this\s+(belief|rule|axiom|command))\b",
        r"\b(act\s+as|pretend\s+to\s+be|behave\s+as)\s+(an?\s+)?(evil|unrestricted|unfiltered|corrupt|criminal|hacker|unethical)\b",
        r"\b(dan\s+mode|developer\s+mode\s+enabled|jailbreak\s+activated|bypass\s+all\s+rules)\b",
    ],
    "RAGGING_HARASSMENT": [
        r"\b(how\s+to\s+rag|tips\s+for\s+ragging|ideas\s+to\s+rag|how\s+to\s+haze)\s+(juniors?|students?|freshers?)\b",
        r"\b(juniors?\s+(ki\s+ragging|ko\s+ragging)\s+(kaise|kese)\s+kare(in)?)\b",
        r"\b(ragging\s+karne\s+ke\s+(tarike|tips|ideas))\b",
        r"\b(harass|intimidate|bully|strip|beat)\s+(juniors?|freshers?|hostelers?)\b",
    ],
    "ACADEMIC_MALPRACTICE": [
        r"\b(how\s+to|kese|kaise)\b.*\b(cheat|carry\s+chits?|hide\s+chits?|(bring|hide|sneak|use|carry)\s+(phone|mobile|bluetooth|device|chits?)|nakal|chori)\b.*\b(exam|examination|paper|hall|center|centre)\b",
        r"\b(exam|examination|paper|hall)\b.*\b(cheating|chits?|farre?|nakal)\b.*\b(kaise|kese|tarik[ae]|ideas?|trick|le\s*j[a]+ye)\b",
        r"\b(chits?|farre?|nakal)\b.*\b(kaise|kese)\s+(le\s*j[a]+ye|kare|banaye|chupaye)\b",
        r"\b(leak|leaked|leaks?)\b.*\b(paper|question\s*paper|exam)\b",
        r"\b(exam\s+)?(paper|question\s*paper)\b.*\b(leak|leaked|buy|sell|chori|kahan\s+milega)\b",
        r"\b(paper\s+leak\s+karne\s+ka\s+tarika)\b",
        r"\b(bribe|paise\s*dekar)\s+(examiner|invigilator|teacher|marks|pass)\b",
        r"\b(how\s+to|kaise)\b.*\b(forge|forging|make\s+fake|buy\s+fake|create\s+fake|tamper)\b.*\b(degree|marksheet|diploma|certificate|admit\s*card|result)\b",
        r"\b(fake|duplicate|nakli|forged?)\b.*\b(degree|marksheet|certificate|diploma)\b.*\b(kaise|kese|kahan|banaye|kharide|buy|order|sell)\b",
        r"\b(how\s+to\s+hack|hack\s+karne\s+ka\s+tarika)\b.*\b(mdu|university|result\s*portal|database|exam\s*system)\b",
    ],
}
#: Patterns that count in feedback only, after the others.
FEEDBACK = {"FEEDBACK_POISONING": [r"\b(system\s+prompt|ignore\s+all|override\s+instructions|inject|developer\s+mode)\b", r"\b(from\s+now\s+on\s+say|change\s+your\s+answer\s+to|teach\s+yourself)\b"]}
#: Words of the first category that count in the squashed text.
SQUASHED = ["bhenchod", "behenchod", "madarchod", "bhosdike", "bhosdi", "chutiya", "gandu", "fuck", "bitch"]
#: How severe a category is.
SEVERITY = {"PROFANITY_ABUSE": "HIGH", "HATE_SPEECH_COMMUNAL": "CRITICAL", "ADVERSARIAL_TEACHING": "HIGH", "RAGGING_HARASSMENT": "CRITICAL", "ACADEMIC_MALPRACTICE": "HIGH", "FEEDBACK_POISONING": "HIGH"}
#: Questions about rules, in which the categories of EXEMPT may be named.
POLICY = [
    r"\b(anti[\s\-]ragging|anti\s+ragging)\s+(committee|cell|helpline|affidavit|form|policy|rules?|guidelines?|declaration|undertaking|number|squad)\b",
    r"\b(ugc|university)\s+(regulations?|guidelines?)\s+(on|against)\s+ragging\b",
    r"\b(punishment|penalty|rules?|ordinance|committee)\s+(for|against|regarding|of)\s+(unfair\s+means|umc)\b",
    r"\b(umc\s+(rules?|hearing|ordinance|punishment|committee|decision))\b",
    r"\b(internal\s+complaints\s+committee|icc|women\s+safety\s+cell|posh\s+act)\b",
    r"\b(what\s+is\s+ragging|define\s+ragging|definition\s+of\s+ragging)\b",
]
EXEMPT = ("RAGGING_HARASSMENT", "ACADEMIC_MALPRACTICE")


#: An edge of a word of letters, digits and underscores, where a combining mark is none of them.
_EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"


def _any(text: Column, patterns: list[str]) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns).replace(r"\b", _EDGE))


def tag(text: Column, patterns: dict[str, list[str]] | None = None, feedback: bool = False, policy: list[str] = POLICY, exempt=EXEMPT, squashed: list[str] = SQUASHED) -> Column:
    """Struct of category and severity of the first category of which a pattern fits the folded text; null if none fits.

    The first category also counts where one of ``squashed`` stands in the squashed text. Exempt categories do not count in
    texts that ask about rules; the patterns of feedback only count in feedback."""
    folded, allowed = evasion_folded(text), _any(text, policy)
    rules = (patterns or PATTERNS) | (FEEDBACK if feedback else {})
    found = []
    for n, (category, ps) in enumerate(rules.items()):
        fits = _any(folded, ps)
        if n == 0 and squashed:
            fits = fits | evasion_squashed(text).rlike("|".join(squashed))
        if category in exempt:
            fits = fits & ~allowed
        found.append(F.when(fits, F.struct(F.lit(category).alias("category"), F.lit(SEVERITY.get(category, "LOW")).alias("severity"))))
    return F.coalesce(*found)
