"""Patterns and word lists of the message grammar, as text. ASCII word boundaries throughout."""

from __future__ import annotations

# ---- fixed values: number glyphs and vocabulary, in the order they apply
DEVANAGARI_DIGITS = "०१२३४५६७८९"
HINDI = (
    (r"बैंक\s*निफ्टी|बैंक\s*निफ़्टी", " BANKNIFTY "),
    (r"निफ्टी|निफ़्टी", " NIFTY "),
    (r"सेंसेक्स", " SENSEX "),
    (r"(\d)\s*(?:कॉल|काल)", "$1 CE "),
    (r"(\d)\s*(?:पुट)", "$1 PE "),
    (r"हाई\s*(?:बनाया|लगाया)", " HIGH MADE "),
    (r"टार[्]?गेट\s*(?:हिट|पूरा|अचीव)", " TARGET HIT "),
    (r"एंट्री(?:\s*लेवल)?", " ENTRY "),
    (r"ख़?रीद(?:ें|ो|े|िए|ना|ी)?|ले\s*लो|बाय", " BUY "),
    (r"बेच(?:ें|ो|े|िए|ना)?|सेल", " SELL "),
    (r"टार[्]?गेट|लक्ष्य", " TGT "),
    (r"स्टॉप\s*लॉस|स्टाप\s*लॉस|एस\s*एल", " SL "),
    (r"(?:के|से)?\s*ऊपर", " ABOVE "),
    (r"(?:के|से)?\s*नीचे", " BELOW "),
    (r"इंट्राडे", " INTRADAY "),
    (r"हिट", " HIT "),
    (r"प्रॉफिट|मुनाफ़?ा", " PROFIT "),
)
HINGLISH = (
    (r"\bK[EI]?\s+(?:UPAR|UPER|OOPAR)\b|\bUPAR\b", " ABOVE "),
    (r"\bK[EI]?\s+(?:NICHE|NEECHE|NEECHEY)\b|\bNICHE\b|\bNEECHE\b", " BELOW "),
    (r"\bKHARID(?:O|E|EN|IYE|NA)?\b|\bLE\s?LO\b|\bLELO\b|\bBUY\s+KAR(?:O|E|EN|NA)\b", " BUY "),
    (r"\bBECH(?:O|E|EN|DO|NA)?\b|\bSELL\s+KAR(?:O|E|EN|NA)\b", " SELL "),
)
# ---- fixed values: cues of promotion, first match per kind
PROMO = (
    ("paid-group", r"\b(?:PREMIUM|VIP|PAID)\s+(?:GROUP|CHANNEL|MEMBER(?:S|SHIP)?|SERVICE|PLAN|CALLS?|SUBSCRIPTION|JOIN)|\b(?:JOIN|TAKE|GET|BUY)\s+(?:OUR\s+)?(?:PREMIUM|VIP|PAID)\b|\bSUBSCRIPTION\s+(?:FEE|CHARGE|PLAN)|\bMEMBERSHIP\b|\bPAY\s*(?:&|AND)\s*JOIN\b|\bLIFETIME\s+(?:ACCESS|PLAN|MEMBERSHIP)"),
    ("payment", r"\b[A-Z0-9._-]{3,}@(?:YBL|OKAXIS|OKHDFCBANK|OKICICI|OKSBI|PAYTM|UPI|IBL|AXL|APL|FBL|KOTAK|SBI|ICICI|HDFCBANK|AXISBANK)\b|\bUPI\s*(?:ID)?\s*[:=-]|\b(?:PHONEPE|GPAY|GOOGLE\s?PAY|PAYTM)\s+(?:NO|NUMBER|ON|TO|:)|\bRAZORPAY\.|\bRZP\.IO|\bONETAPAY\.|\bCOSMOFEED\.|\bSUPERPROFILE\.|\bGRAPHY\.|\bTOPMATE\.|\bA\/C\s*(?:NO|NUMBER)|\bIFSC\b|\bSCAN\s+(?:THE\s+)?QR"),
    ("contact", r"\bDM\b|\bINBOX\b|\bPING\s+ME\b|\bMSG\s+(?:ME|ON)\b|\bMESSAGE\s+(?:ME|US|ON)\b|\bWHATSAPP\b|\bWA\.ME\b|\bCONTACT\s+(?:ME|US|ADMIN|ON)\b|\bCALL\s+(?:ME|US)\s+(?:ON|AT)\b"),
    ("join-link", r"\bT\.ME\/(?:\+|JOINCHAT)|\bTELEGRAM\.ME\/|\bCHAT\.WHATSAPP\.COM\/|\bJOIN\s+(?:FAST|NOW|HERE|US|OUR|FREE|LINK)"),
    ("guarantee", r"\bSURE\s?SHOT\b|\b100\s*%|\bGUARANTEED?\b|\bJACKPOT\b|\bNO\s+LOSS\b|\bZERO\s+LOSS\b|\bRISK\s?FREE\b|\bLOSS\s+RECOVER(?:Y)?\b|\bDOUBLE\s+(?:YOUR\s+)?(?:MONEY|CAPITAL)\b|\bFIXED\s+(?:PROFIT|RETURN)|\bDAILY\s+(?:PROFIT|INCOME)\s+(?:OF\s+)?\d|\bMULTIBAGGER\b|\bROCKET\b|\b\dX\s+RETURN"),
    ("profit-brag", r"\b(?:PROFIT|GAIN(?:ING|ED)?|EARN(?:ED|ING)?|MADE)\s*(?:OF\s+)?(?:RS\.?\s*)?[-:]?\s*\d[\d,.]*\s*(?:K|L|LAKH|LAC|CR|\/-|\/|\+)?|\b\d[\d,.]*\s*(?:K|L|LAKH|LAC)\s+(?:PROFIT|GAIN)|\bPROFIT\s+SCREENSHOT|\bMEMBERS?\s+(?:PROFIT|EARN)"),
    ("urgency", r"\bLIMITED\s+(?:SEATS?|SLOTS?|TIME|OFFER)|\bLAST\s+(?:CHANCE|DAY|FEW)|\bHURRY\b|\bOFFER\s+(?:ENDS?|VALID|CLOS)|\bONLY\s+\d+\s+(?:SEATS?|SLOTS?|MEMBERS?)|\bDON'?T\s+MISS\b|\bFAST\s+FAST\b"),
    ("paywalled-levels", r"\b(?:SL|S\.L|STOP\s*LOSS|STOPLOSS|TARGETS?|TGT)\s*[:\-]*\s*(?:IS\s+|IN\s+)?(?:PAID|PREMIUM|VIP|CLICK\s+HERE)\b|\b(?:TARGET|STOP\s*LOSS|STOPLOSS)[^\n]{0,40}\bEXCLUSIVELY\s+FOR\b"),
    ("account-handling", r"\bACCOUNT\s+(?:HANDLING|MANAGEMENT|HANDLE)|\bHANDL(?:E|ING)\s+YOUR\s+ACCOUNT|\bPROFIT\s+SHARING\b|\bPMS\s+SERVICE|\bWE\s+(?:WILL\s+)?TRADE\s+(?:IN|ON)\s+YOUR"),
)
# every match of a kind holds one of these: texts without them need no search
PROMO_WORDS = {
    "paid-group": ("PREMIUM", "VIP", "PAID", "SUBSCRIPTION", "MEMBERSHIP", "PAY", "LIFETIME"),
    "payment": ("@YBL", "@OK", "@IBL", "@AXL", "@APL", "@FBL", "@KOTAK", "@SBI", "@ICICI", "@HDFCBANK", "@AXISBANK", "UPI", "PHONEPE", "GPAY", "GOOGLE", "PAYTM", "RAZORPAY", "RZP.IO", "ONETAPAY", "COSMOFEED", "SUPERPROFILE", "GRAPHY", "TOPMATE", "A/C", "IFSC", "SCAN"),
    "contact": ("DM", "INBOX", "PING", "MSG", "MESSAGE", "WHATSAPP", "WA.ME", "CONTACT", "CALL"),
    "join-link": ("T.ME/", "TELEGRAM.ME/", "CHAT.WHATSAPP", "JOIN"),
    "guarantee": ("SURE", "100", "GUARANTEE", "JACKPOT", "LOSS", "RISK", "DOUBLE", "FIXED", "DAILY", "MULTIBAGGER", "ROCKET", "RETURN"),
    "profit-brag": ("PROFIT", "GAIN", "EARN", "MADE"),
    "urgency": ("LIMITED", "LAST", "HURRY", "OFFER", "ONLY", "MISS", "FAST"),
    "paywalled-levels": ("PAID", "PREMIUM", "VIP", "CLICK", "EXCLUSIVELY"),
    "account-handling": ("ACCOUNT", "SHARING", "PMS", "TRADE"),
}
SELLING = ("paid-group", "payment", "contact", "join-link", "urgency", "account-handling", "paywalled-levels")
# ---- fixed values: result posts
RESULT = r"\b(?:TARGETS?|TGT|TG)\s*(?:[123]|1ST|2ND|3RD|FIRST|SECOND|THIRD|FINAL|ALL|BOTH)?\s*(?:FULL\s+|ALMOST\s+)?(?:HITS?|DONE|ACHIEVED|ACHIVED|COMPLETED?|GIVEN|REACHED)\b|\b(?:HITS?|ACHIEVED|ACHIVED|OVERACHIEVED|OVERACHIVED)\b|\bBOOK(?:ED|ING)?\s+(?:FULL\s+|PARTIAL\s+|PART\s+|YOUR\s+|SOME\s+|HALF\s+)?PROFITS?\b|\bPROFITS?\s+BOOK(?:ED)?\b|\bBOOKED\b|\bHIGH\s+MADE\b|\bMADE\s+(?:A\s+|NEW\s+)?(?:LIFETIME\s+)?(?:HIGH|LOW)\b|\b\d+\s*(?:POINTS?|PTS)\s*(?:PROFIT|GAIN|UP|DONE|MOVE)|\bDOUBLED?\b|\bREACHED\s+ALL\b|\bTODAY\s+\d+(?:\.\d+)?\s*%\s*\+?\s*UP\b|\bPROFITS?\b"
STOPPED = r"\b(?:SL|STOP\s*LOSS|STOPLOSS)\s*(?:HITS?|TRIGGERED|TRIGGER|DONE)\b|\bSTOPPED\s+OUT\b|\bSTOP\s+OUT\b|\bEXIT\s+(?:WITH|IN|AT)\s+(?:SMALL\s+)?LOSS\b|\bLOSS\s+BOOK(?:ED)?\b|\bBOOK(?:ED)?\s+LOSS\b"
ALMOST = r"\b(?:ALMOST|NEAR(?:LY)?|ABOUT\s+TO|CLOSE\s+TO)\b"
EXITED = r"\bEXIT\b|\bSQUARE\s*OFF\b|\bCLOSE\s+(?:THE\s+)?POSITION\b|\bCOST\s+TO\s+COST\b|\bEXIT\s+AT\s+COST\b"
LEADING_STATUS = r"^\W*(?:STOPPED\s+OUT|STOP\s+OUT|SL\s+HIT|BOOK\s+(?:PART\s+|FULL\s+|PARTIAL\s+)?PROFIT|TARGETS?\s+(?:ACHIEVED|HIT|DONE)|EXIT\b|UPDATE\b|INTRADAY\s+UPDATE\b)"
ACTION = r"\b(BUY|BOUGHT|BUYING|SELL|SOLD|ACCUMULATE)\b|\b(?:GO\s+)?(?:LONG|SHORT)\b(?=\s*[:#]|\s+(?:IN|ON)\b)|\bGO\s+(?:LONG|SHORT)\b|\bSHORT\b(?=\s+[A-Z&]+\s+(?:BELOW|ABOVE|AT|@|CMP|FUT|\d))"
SHORT_SIDE = r"\b(?:SELL|SOLD)\b|\bSHORT\b(?!\s*(?:TERM|SIDE|COVERING|TIME|STRANGLE|STRADDLE))"
# ---- fixed values: price levels and their words
NUM = r"\d+(?:\.\d+)?"
MONTH = "(JAN(?:UARY)?|FEB(?:RUARY)?|MAR(?:CH)?|APR(?:IL)?|MAY|JUNE?|JULY?|AUG(?:UST)?|SEPT?(?:EMBER)?|OCT(?:OBER)?|NOV(?:EMBER)?|DEC(?:EMBER)?)"
TARGET_KEY = r"(?:TARGETS?|TGTS?|TRGT|TRG|TG|TP|T[123]|CAN\s+TOUCH|MAY\s+TOUCH)"
STOP_KEY = r"(?:STOP\s*LOSS|STOPLOSS|S\.L\.?|S/L|CBSL|SL)"
OPTION = rf"(?<![\d.])({NUM})\s*(?:STRIKE\s*)?(CE|PE|CALLS?|PUTS?)\b"
STOP_LEVEL = rf"\b{STOP_KEY}\s*(?:PRICE|LEVEL)?\s*[:=>.\-@]*\s*(?:AT|BELOW|ABOVE|NEAR|OF|IS|JUST)?\s*[:=-]?\s*({NUM})"
TARGET_LEVEL = rf"\b{TARGET_KEY}\s*(?:[123]\s*[:=)\-]\s*|[123]\s+(?=\d))?(?:PRICE)?[\s:=>.\-]*((?:{NUM}\+*\s*(?:[/,&\-]+|\bTO\b|\bAND\b)?\s*){{1,8}})"
SOFT_TARGET_KEY = "(?:VIEW|EXPECTING|EXPECTED|RESISTANCE|UPSIDE)"
SOFT_STOP_KEY = "(?:SUPPORT)"
TRADE_HEAD = r"\b(?:TRADE|IDEA|RECOMMENDATION|INTRADAY|BTST|SWING|POSITIONAL|DELIVERY)\b"
AWAY = r"(\s*(?:POINTS?|PTS?)\b|\s*(?:-\s*\d+(?:\.\d+)?\s*)?%)?"
NOT_PRICE = rf"(?!\s*(?:ST|ND|RD|TH|SHARES?|LOTS?|QTY|QUANTITY|DAYS?|WEEKS?|MONTHS?|MINS?|MINUTES?|HRS?|EMA|SMA|DMA|TF|PTS?|POINTS?|{MONTH[1:-1]})\b)(?!\s*%)"
SEP = r"\s*(?:OF|IS)?\s*[@:=-]?\s*"
SPAN = rf"({NUM}){NOT_PRICE}(?:\s*(?:-+|TO|/|&|AND)\s*({NUM}))?"
ENTRY_ABOVE = (rf"\b(?:ABOVE|ABV|OVER|CROSS(?:ES|ING)?){SEP}{SPAN}", rf"(?<![\d.])({NUM})\s*ABOVE\b")
ENTRY_BELOW = (rf"\b(?:BELOW|BLW|UNDER){SEP}{SPAN}", rf"(?<![\d.])({NUM})\s*BELOW\b")
ENTRY_AT = (rf"(?:@|\b(?:AT|NEAR|NR|AROUND|ENTRY|RANGE|BETWEEN|PRICE|ZONE|LEVEL)\b)\s*(?:PRICE|RANGE|ZONE|LEVEL)?{SEP}{SPAN}", rf"\b(?:CMP|LTP){SEP}{SPAN}", rf"(?<![A-Z0-9.]){SPAN}(?![A-Z0-9])")
TARGETS_AFTER_TO = rf"\b(?:ABOVE|BELOW|AT|@|CMP)\s*{NUM}\s*(?:TO|FOR)\s+((?:{NUM}\+*\s*[/,\-]?\s*){{2,6}})"
DAY_MONTH = rf"(?<![\d.])(\d{{1,2}})\s*(?:ST|ND|RD|TH)?[\s.-]*{MONTH}"
MONTH_DAY = rf"\b{MONTH}\s*(\d{{1,2}})\b(?!\d)"
MONTH_ONLY = (rf"\b{MONTH}\b", rf"\b{MONTH}\s+(?:EXPIRY|EXP|SERIES|CONTRACT)\b", rf"\b(?:EXPIRY|EXP|MONTHLY)\s*[:=-]?\s*{MONTH}\b")
RUNNING = rf"\bCMP(?:\s+PRICE)?\W{{0,6}}({NUM})\W{{1,8}}{NUM}\W{{0,3}}(?:POINTS?|PTS)\b"
MOVE = rf"(?<![\d.])({NUM})\s*(?:TO|>+|-+>)\s*({NUM})(?![\d.])"
CLAIM_A = r"(\d{2,3}(?:\.\d+)?)\s*%\s*(?:\+\s*)?(?:ACCURACY|ACCURATE|SUCCESS|WIN|STRIKE\s*RATE|SURE|GUARANTEE)"
CLAIM_B = r"(?:ACCURACY|SUCCESS\s*RATE|WIN\s*RATE|STRIKE\s*RATE|ACCURATE)[^\d\n]{0,20}(\d{2,3}(?:\.\d+)?)\s*%"
DIVIDER = r"\n\s*[-_=—]{4,}[^\n]*\n|\n\s*(?:DISCLAIMER|DISC\b|NOTE\s*:)"
REG_NO = r"\bIN[HA](?:\d{9}|IFSC\d{5})\b"
REG_WORDS = r"SEBI\s+(?:REG|REGISTERED|REGISTRATION|REGD)"
BTST, STBT = r"\bBTST\b", r"\bSTBT\b"
INTRADAY = r"\bINTRA\s?DAY\b|\bSCALP|\bHERO\s*(?:OR\s*)?ZERO\b|\bZERO\s*(?:TO\s*)?HERO\b|\bEXPIRY\s+(?:SPECIAL|TRADE|DAY|JACKPOT)\b"
POSITIONAL = r"\bPOSITIONAL\b|\bPOSTIONAL\b|\bLONG\s?TERM\b|\bDELIVERY\b|\bMULTIBAGGER\b|\b\d+\s*(?:-\s*\d+\s*)?(?:WEEKS?|MONTHS?)\b"
SWING = r"\bSWING\b|\bSHORT\s?TERM\b|\b\d+\s*(?:-\s*\d+\s*)?DAYS?\b"
ENTITIES = (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "))


def target_level(soft: bool) -> str:
    """A target's numbers (group 1), and whether they are points or percent away (group 2)."""
    key = f"(?:{TARGET_KEY}|{SOFT_TARGET_KEY})" if soft else TARGET_KEY
    return rf"\b{key}\s*(?:[123]\s*[:=)\-]\s*|[123]\s+(?=\d))?(?:PRICE)?[\s:=>.\-]*((?:{NUM}\+*\s*(?:[/,&\-]+|\bTO\b|\bAND\b)?\s*){{1,8}}){AWAY}"


def stop_level(soft: bool) -> str:
    key = f"(?:{STOP_KEY}|{SOFT_STOP_KEY})" if soft else STOP_KEY
    return rf"\b{key}\s*(?:PRICE|LEVEL)?\s*[:=>.\-@]*\s*(?:AT|BELOW|ABOVE|NEAR|OF|IS|JUST)?\s*[:=-]?\s*({NUM}){AWAY}"


def level_start(soft: bool) -> str:
    return rf"\b(?:{TARGET_KEY}|{STOP_KEY}" + (f"|{SOFT_TARGET_KEY}|{SOFT_STOP_KEY}" if soft else "") + r")\b"


def led(pattern: str) -> str:
    """The same pattern with the word boundary that begins every alternative taken out in front of all: it is then tried
    at the edges of words only, not each alternative at each place. As it is where an alternative begins otherwise."""
    parts, depth, inside, i = [""], 0, False, 0
    while i < len(pattern):
        x = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(x)
        inside = x == "[" or (inside and x != "]")
        depth += 0 if inside else (x == "(") - (x == ")")
        if x == "|" and depth == 0 and not inside:
            parts.append("")
        else:
            parts[-1] += x
    return r"\b(?:" + "|".join(p[2:] for p in parts) + ")" if all(p.startswith(r"\b") for p in parts) else pattern


def bounded(pattern: str) -> str:
    """The pattern with ASCII word boundaries, which Java's own are not beside other scripts."""
    return pattern.replace(r"\b", "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")
