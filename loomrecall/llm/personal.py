"""Personal information in free text: found, and replaced by keyed surrogates or typed placeholders.

Each field is scanned for emails (plain, spelled out, encoded), phone numbers, numbers of personal papers, postal addresses and names of
people, and each entity is replaced by a keyed surrogate of its own kind (``surrogates``) or a typed placeholder. Surrogates are checked on
the distinct parts of all entities as a Spark table: parts that meet on one surrogate, or on a part that really occurs, are drawn again, so
different entities stay different and repeated mentions stay recognizable. What is found is what was replaced.

Defined cases: null and empty fields hold nothing; repeated rows count once; JSON fields are read string by string with their escapes
decoded, broken JSON is read as plain text; whole texts of any length are read; empty tables give empty tables; extra columns are not read.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrecall.llm.surrogates import PARTICLES, draw, luhn, mark_of, parts_of, rewrite
from loomrecall.llm.words import GIVEN
from loomrecall.session import materialize, spread

KINDS = ("email", "phone", "id_number", "address", "name")

_EMAIL = regex.compile(
    r"""(?<![\w.+%@/-])(?:mailto:)?(?:\\?"[\w.+ -]{1,64}\\?"|[\p{L}\p{N}][\p{L}\p{N}._+'-]{0,63})(?:@|%40|&\#64;|&\#x40;|&commat;|\\u0040|＠|﹫|\s?[\[({<]\s?(?:at|AT|At|@)\s?[\])}>]\s?)(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,62})(?:\.|\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?|%2[Ee]|&\#46;))+\p{L}{2,24}(?![\p{L}\p{N}_])"""
    r"""|(?<![\w.+@-])[\p{L}\p{N}][\p{L}\p{N}._+'-]{0,63}\s(?:at|AT)\s(?:[\p{L}\p{N}][\p{L}\p{N}-]{0,62}\s(?:dot|DOT)\s)+\p{L}{2,24}(?![\p{L}\p{N}])"""
)
_REMOTE = re.compile(r"(?i)^(?:git|hg|svn|ssh|gitlab|github)$")
_VERSION = re.compile(r"^[\w./-]*@v?\d")

_EXT = r"(?:\s?(?:ext\.?|x|#|durchwahl|poste|extension)\s?\d{1,6})?"
_PHONE = re.compile(
    r"(?<![\w.+/-])(?:"
    r"(?:\+|00)\d{1,3}[ .\-/]?(?:\(0\)[ .\-/]?)?(?:\(?\d{1,5}\)?[ .\-/]?){1,5}\d{2,}"
    r"|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|1[-. ]\d{3}[-. ]\d{3}[-. ]\d{4}"
    r"|0\d(?:[ .]\d\d){4}|0\d{4}[ ]?\d{6}|0\d{2,4}[ /-]{1,3}\d{3,8}(?:-\d{1,5})?|0\d{3} \d{3} \d{4}|\(0\d{2,5}\) ?\d{3,8}(?: \d{3,4})?"
    rf"){_EXT}(?![\w/]|[.,:-]\d)"
)
_NO_PHONE = re.compile(r"(?i)(?:\b(?:key|id|run|offset|lines?|epoch|addr|port|build|version|sha|hash|ticket|order|row|rows|seq|rev)\b[=:# ]{1,2})$")
_NO_PHONE_AFTER = re.compile(r"(?i)^\s*(?:ms|msec|seconds?|rows?|bytes?|tokens?|kb|mb|of the dump|in the byte)\b")

_ID_WORD = r"(?:passport|id card|identity card|identification|personal id|national id|identity|driv(?:ing|er'?s?) licen[cs]e|licen[cs]e|(?:national )?insurance|social security|ssn|social insurance|tax|tin|vat id|steuer-?id|steuernummer|steuer(?:liche)?|personalausweis|ausweis|reisepass|führerschein|sozialversicherung\w*|versicherung\w*|passeport|carte d'identité|permis de conduire|sécurité sociale|numéro fiscal|pasaporte|dni|nie|carnet de conducir|seguridad social|codice fiscale|bank account|account|iban|bic|sort code|credit card|debit card|card|konto|kontonummer|personnummer|personal number|cpr|cpf|bsn|pesel|nhs|medicare|medical|health)"
_ID = re.compile(r"(?<![\w-])(?:\d{3}-\d{2}-\d{4}|(?:19|20)\d{6}-\d{4}|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{5}-?\d{6}-?[A-Z0-9]{4,5})(?![\w-])")
_ID_NAMED = re.compile(
    rf"(?i:\b{_ID_WORD})(?i:[ -]*(?:no|number|nr|num|nummer|numéro|número|n°|id|#)\.?)?[:=#]?\s*(?i:is |ist |: )?(?=[A-Z\d -]*\d)(?P<v>[A-Z\d](?:[A-Z\d]|[ -](?=[A-Z\d])){{5,30}})(?![\w])"
)
#: Parts of the words above; a text with none of them needs no search for them.
_ID_GATE = ("passport", "passeport", "pasaporte", "reisepass", "id card", "identi", "personal", "national", "licen", "insurance", "social", "ssn", "tax", "tin ", "tin:", "vat id", "steuer", "ausweis", "führerschein", "versicherung", "permis", "sécurité", "fiscal", "dni", " nie", "carnet", "seguridad", "account", "iban", " bic", "sort code", " card", "konto", "personnummer", " cpr", " cpf", " bsn", "pesel", " nhs", "medic", "health")
_CARD = re.compile(r"(?<![\w.-])\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?![\w-])")

_TYPE = r"(?:street|avenue|lane|road|drive|close|mews|rise|court|square|terrace|place|crescent|gardens|grove|boulevard|parkway|alley|quay|embankment|highway|walk|wharf|row|hill|gate|green|park|way|view)"
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’.-]*"
_STREET = rf"(?:(?:{_CAP} ){{1,3}}(?i:{_TYPE})|(?i:rue|avenue|boulevard|chemin|place|impasse|calle|avenida|plaza|paseo|camino|via|viale|piazza|corso|largo|praça|rua)(?: (?:de la|de los|de las|de l'|del|des|de|du|da|do|dei|della|la|le|les|los|el|il))? {_CAP}(?: {_CAP}){{0,2}}|{_CAP}(?:straße|strasse|weg|allee|platz|gasse|ring|ufer|damm|gatan|vägen|gränd|vej|gade|veien|straat|laan|gracht|plein)|[A-ZÄÖÜ][a-zäöüß]+(?:er|scher|n) (?:Straße|Strasse|Weg|Allee|Platz|Ring|Ufer|Damm|Str\.))"
_STREET_LOW = rf"(?:(?:[a-z'’.-]+ ){{1,3}}{_TYPE}|(?:rue|boulevard|chemin|impasse|calle|avenida|plaza|paseo|camino|via|viale|piazza|corso)(?: (?:de la|des|de|du|del|dei|della|la|le|les|los))? [\w'’-]+(?: [\w'’-]+)?|[a-zäöüß]+(?:straße|strasse|weg|allee|platz|gasse|ring|ufer|gatan|vägen|straat|laan))"
_TAIL = rf"(?:,? (?:\d{{4,6}} )?{_CAP}(?: [A-ZÀ-ÖØ-Þ][\w'’-]{{2,}})?(?: \d{{4,6}})?|, \d{{4,6}}\b[^\n,;.]{{0,30}})?"
_ADDRESS = re.compile(
    rf"(?i:\b(?:p\.? ?o\.? ?box|postfach|apartado(?: de correos)?|boîte postale|b\.p\.|casella postale|postbus|postboks) ?(?:no\.? ?|nr\.? ?)?\d{{1,6}}\b){_TAIL}"
    rf"|(?:(?i:c/o) [\w ]{{2,30}}, )?(?:(?i:flat|apt\.?|apartment|unit|suite|wohnung) ?\d+\w?,? )?\b\d{{1,4}}(?: ?[a-zA-Z])?,? (?P<a>{_STREET})(?P<ta>{_TAIL})"
    rf"|\b(?P<b>{_STREET}) \d{{1,4}}(?: ?[a-zA-Z])?\b(?P<tb>,? ?(?:\d{{4,6}}|\d{{1,2}}\. (?:Stock|Etage|OG))?{_TAIL})"
    rf"|\b\d{{1,4}}(?: ?[a-z])? (?P<c>{_STREET_LOW})(?: [a-z][\w-]+(?: [a-z][\w-]+)?)?"
)
#: Parts of every street word; a text with none of them has no address.
_STREET_GATE = ("street", "avenue", "lane", "road", "drive", "close", "mews", "rise", "court", "square", "terrace", "place", "crescent", "garden", "grove", "boulevard", "parkway", "alley", "quay", "embankment", "highway", "walk", "wharf", " row", "hill", " gate", "green", " park", " way", " view", "rue ", "chemin", "impasse", "calle", "avenida", "plaza", "paseo", "camino", "via ", "viale", "piazza", "corso", "largo", "praça", "rua ", "straße", "strasse", "str.", "weg", "allee", "platz", "gasse", "ring", "ufer", "damm", "gatan", "vägen", "gränd", "vej", "gade", "veien", "straat", "laan", "gracht", "plein", "box", "postfach", "apartado", "boîte", "b.p.", "casella", "postbus", "postboks", "c/o")
#: Lower-case words that may follow a capitalized address; another noun there means that the words name something else.
_FOLLOW = re.compile(
    r"(?i)^(?:\s*$|\s*[^\w\s]|\s*\n|\s+(?:\d|\W|(?:instead|last|since|until|till|once|when|whenever|if|unless|on|in|only|during|before|after|for|from|to|with|without|while|because|at|as|and|or|but|is|was|were|by|near|opposite|again|now|then|next|this|that|the|a|an|we|it|i|they|he|she|who|where|which|see|don't|open|both|version|please|today|tomorrow|yesterday|und|oder|seit|bis|et|ou|depuis|y|desde|hasta|[A-ZÀ-Þ])\b))"
)

#: Role nouns of components: two capitalized words that end in one name no person.
_ROLE = frozenset("guard check blender worker writer index indexer observer holder tracker comparer importer exporter scanner builder cache store log filter pool loop marker list timer step pass queue dispatcher inspector refresher poller planner sweep shim stage trimmer registry switcher panel reader job matcher vector budget engine service server client manager handler router loader parser runner engineer team bot agent system project board report desk office map graph tool hook table node record token session bridge gateway monitor controller adapter module process task thread lock lease band box page view mode state flow path line key file alpha beta gamma delta build release sprint".split())
_STOP = frozenset("the a an it its see we open both version next don't when if until once since unless while because without for with only as on at in of after during before not no yes this that these those there here what why how who can could should would may please reviewed assigned waiting thanks regards merci gruß call text send left invoice ship verification moved main project calle rue via po box ip in i you he she they from to and or but by is was are were be been has had have do does did new old just also then than so such more most very all any each every some one two three der die das und le la les et el los las y dear hi hello cc stand état estado during note ticket item".split())
#: First words of titles, places, days and products.
_NO_FIRST = frozenset("monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december project product team group san santa saint north south east west upper lower great grand visual google microsoft apple amazon open github gitlab apache product senior junior chief general vice last first next every each no good bad mean quiet".split())
_W = r"\p{L}[\p{L}\p{M}'’-]*"
_PART = r"(?:(?i:van der|van den|van de|von der|de la|de los|van|von|vom|zu|de|del|della|di|da|dos|du|le|la|el|al|bin|ibn|ter|ten|af|av)\s+)?"
_TITLE = regex.compile(rf"(?<![\p{{L}}\p{{N}}_])(?P<t>Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Herr|Hr|Frau|Fr|Monsieur|Madame|Mme|Mlle|Señora?|Sra?|Signora?|Don|Doña|Sir|Lady|Mister)\.?\s+(?:Dr\.?\s+)?(?P<n>(?:\p{{Lu}}\.\s?)?{_PART}(?:al-|el-|O['’]|d['’])?\p{{Lu}}{_W[5:]}(?: \p{{Lu}}{_W[5:]})?)")
_INITIAL = regex.compile(rf"(?<![\p{{L}}\p{{N}}_.])(?:\p{{Lu}}\.\s?){{1,2}}{_PART}(?:al-|O['’])?(?P<s>\p{{Lu}}[\p{{L}}'’-]{{2,}})")
_REST = regex.compile(rf"[ \t]+(?P<x>(?:\p{{Lu}}\.(?!\p{{L}})[ \t]*)?(?P<p>{_PART})(?P<s>{_W}))")
_COMMA = regex.compile(rf"(?<![\p{{L}}\p{{N}}_.@/-])(?P<s>{_PART}(?:al-|O['’])?\p{{Lu}}[\p{{L}}\p{{M}}'’-]+),[ \t](?P<g>{_W})(?![\p{{L}}\p{{N}}_@])")
_FOREIGN = regex.compile(r"(?<![\p{L}\p{N}_])(?:(?=\p{Cyrillic})\p{Lu}[\p{Cyrillic}-]+(?:\s\p{Lu}[\p{Cyrillic}-]+){1,2}|(?=\p{Greek})\p{Lu}[\p{Greek}-]+(?:\s\p{Lu}[\p{Greek}-]+){1,2})(?![\p{L}\p{N}_])")
_CARRIER = regex.compile(
    rf"(?i:\b(?:reviewed by|signed-off-by:?|co-authored-by:?|author:?|written by|approved by|reported by|my name is|i am|assigned to|cc:|thanks,|regards,|cheers,|gruß,|grüße,|viele grüße,|merci à|cordialement,|saludos,|contact card:|contact:|customer|client:|patient|employee|owner[:=]|user=|name[:=]|taken over by|i paired with|in the call|please ask|patch from|it was|waiting for|according to|notes are by|with)\s*)(?P<n>(?:\p{{Lu}}[\p{{L}}\p{{M}}'’-]+)(?:\s\p{{Lu}}[\p{{L}}\p{{M}}'’-]+)?\s{_PART}(?:al-|O['’])?\p{{Lu}}[\p{{L}}\p{{M}}'’-]+)(?![\p{{L}}\p{{N}}_(])"
)
#: What people do, and what is done to people: two capitalized words there name a person, whatever their given name.
_DOES = r"(?:said|says|wrote|writes|asked|asks|replied|answered|confirmed|approved|signed|joined|called|emailed|phoned|noticed|suggested|proposed|agreed|mentioned|explained|complained|apologi[sz]ed|resigned|moved to|lives|works (?:at|for|in)|sagte|schrieb|fragte|a dit|a écrit|dijo|escribió)"
_DONE_TO = r"(?:asked|told|met|emailed|called|phoned|thanked|interviewed|hired|invited|greeted|visited|spoke (?:to|with)|talked (?:to|with)|(?:e-?mail(?:ed)?|message|letter|call|invoice|note) (?:to|from)|emailed to|born to|married to|signed by|sent by|traf|fragte)"
_UP = "A-ZÀ-ÖØ-Þ\u0100-\u017fΑ-ΩА-Я"
#: Two capitalized words, with an initial or a particle between them.
_TWO = re.compile(rf"(?<![\w.@/-])[{_UP}][\w'’-]+ (?:[{_UP}]\. )?(?:(?:van der|van den|van de|von der|de la|de los|van|von|zu|de|del|della|di|da|dos|du|le|la|el|al|bin|ibn|ter|af) )?(?:al-|O['’])?[{_UP}][\w'’-]+")
_THEN = re.compile(rf",?(?:'s (?:phone|email|address|manager)| (?:who |also |then |just )?{_DOES}\b)")
_BEFORE = re.compile(rf"\b{_DONE_TO} $")
_MORE = re.compile(rf" [{_UP}]")
#: Chinese names, mobile numbers and addresses, where a word says what they are.
_HAN_SIGN = regex.compile(r"\p{Han}")
_HAN_FAMILY = "王李张刘陈杨黄赵周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
_HAN_NAME = regex.compile(rf"(?:联系人|姓名|作者|申请人|收件人|负责人|客户|员工)[:：是为]?\s*(?P<n>[{_HAN_FAMILY}]\p{{Han}}{{1,2}})(?!\p{{Han}})|(?<!\p{{Han}})(?P<m>[{_HAN_FAMILY}]\p{{Han}}{{0,2}})(?=先生|女士|小姐|老师|经理|博士|教授)")
_HAN_PHONE = regex.compile(r"(?:电话|手机|联系方式|号码)[:：是为]?\s*(?P<n>(?:\+?86[- ]?)?1[3-9]\d[- ]?\d{4}[- ]?\d{4})(?!\d)")
_HAN_ADDRESS = regex.compile(r"(?:\p{Han}{2,9}?[省市区县])+\p{Han}{1,12}?[路街道巷]\d+号(?:\d+[楼室])?")
_BESIDE, _WITHIN = "_.@/-", "'’-"
_ANY_WORD = re.compile(r"[^\W\d_]+")
_CARRIER_GATE = ("by", "author", "my name", "i am", "assigned", "cc:", "thanks", "regards", "cheers", "grü", "gruß", "merci", "cordial", "saludos", "contact", "customer", "client", "patient", "employee", "owner", "user", "name", "paired", "the call", "please ask", "patch from", "it was", "waiting", "according", "with")
_CAMEL = re.compile(r"[a-z][A-Z]")


def _signs(words: tuple[str, ...]) -> ahocorasick.Automaton:
    """Finds the first of many words in one pass over a text."""
    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, 1)
    out.make_automaton()
    return out


_ID_SIGNS, _STREET_SIGNS, _CARRIER_SIGNS = _signs(_ID_GATE), _signs(_STREET_GATE), _signs(_CARRIER_GATE)


def _surname(w: str, lower: bool) -> bool:
    bare = w.strip("'’-")
    low = bare.lower()
    if len(bare) < 3 or low in _STOP or low in _ROLE:
        return False
    if lower:
        return bare == low and len(bare) >= 5
    return bare[0].isupper() or bool(re.match(r"(?:al|el|d|o)[-'’][A-ZÀ-Þ]", bare))


def _add(spans: list, kind: str, a: int, b: int, text: str) -> None:
    if kind == "address" and (tail := re.search(r"(?:[\s.,]+(\w+))$", text[a:b])) and tail.group(1).lower() in _STOP:
        b = a + tail.start()
    while b > a and text[b - 1] in " ,;.\n\t":
        b -= 1
    if b > a and not any(a < e and s < b for _, s, e in spans):
        spans.append((kind, a, b))


def find_entities(text: str, given: frozenset[str] = GIVEN) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each entity, without overlap, in order."""
    spans: list[tuple[str, int, int]] = []
    low = text.lower()
    if "@" in text or "%40" in text or "＠" in text or "&#" in text or "&com" in text or "u0040" in text or (" at " in low and " dot " in low) or "at]" in low or "at)" in low or "at}" in low or "at >" in low or "﹫" in text:
        for m in _EMAIL.finditer(text):
            local = re.split(r"@|%40|＠|&#64;| at |\[", m.group().removeprefix("mailto:"))[0].strip()
            after = text[m.end() : m.end() + 1]
            if _VERSION.match(m.group()) or (_REMOTE.match(local) and after in (":", "/")) or (after == ":" and re.match(r":[\w~-]+/", text[m.end() : m.end() + 40])):
                continue
            if text[max(0, m.start() - 3) : m.start()].endswith("://") and after in ("/", ":"):
                continue
            a, b = m.span()
            _add(spans, "email", a, b, text)
    if re.search(r"\d", text):
        if re.search(r"\d{2}", text):
            found = list(_ID.finditer(text)) + (list(_ID_NAMED.finditer(text)) if next(_ID_SIGNS.iter(low), None) else [])
            for m in found:
                named = m.re is _ID_NAMED
                a, b = m.span("v") if named else m.span()
                if named and not _plausible_id(m.group("v"), m.group()):
                    continue
                if named and (g := re.match(r"\S{7,}(?= )", m.group("v"))):
                    b = a + g.end()
                if re.search(r"(?i)\b(?:build|release|snapshot|version|backup|log|job|batch|migration)\s?$", text[max(0, a - 12) : a]):
                    continue
                if not named and re.search(r"(?i)(?:key|ticket|sha|hash|run)[=: ]\s?$", text[max(0, a - 8) : a]) and not re.match(r"\d{3}-\d\d-\d{4}|[A-Z]{2} ?\d|\d{8}-", m.group()):
                    continue
                _add(spans, "id_number", a, b, text)
            # Eight digits are the fewest that a card or phone number has.
            long = len(re.findall(r"\d", text)) >= 8
            for m in _CARD.finditer(text) if long else ():
                if luhn(re.sub(r"\D", "", m.group())):
                    _add(spans, "id_number", *m.span(), text)
            for m in _PHONE.finditer(text) if long else ():
                digits = sum(c.isdigit() for c in re.split(r"(?i)ext|x|#", m.group())[0])
                if not 8 <= digits <= 16 or (m.group()[0] not in "+(" and _NO_PHONE.search(text[max(0, m.start() - 14) : m.start()])) or _NO_PHONE_AFTER.match(text[m.end() : m.end() + 16]):
                    continue
                _add(spans, "phone", *m.span(), text)
        for m in _ADDRESS.finditer(text) if next(_STREET_SIGNS.iter(low), None) else ():
            part = m.group("a") or m.group("b")
            a, b = m.span()
            if part:
                tail = m.group("ta") if m.group("a") else m.group("tb")
                if not (tail or "").strip(" ,") and not _FOLLOW.match(text[b : b + 14]):
                    continue
                if re.search(r"(?i)\broad map\b|^(?:section|version|step|item|line|page|figure|table)\b", part):
                    continue
            elif m.group("c") and not _low_address(text, m):
                continue
            _add(spans, "address", a, b, text)
    if not text.isascii() and _HAN_SIGN.search(text):
        for kind, form in (("phone", _HAN_PHONE), ("address", _HAN_ADDRESS), ("name", _HAN_NAME)):
            for m in form.finditer(text):
                group = 0 if kind == "address" else "n" if m.group("n") else "m"
                _add(spans, kind, *m.span(group), text)
    _names(text, low, spans, given)
    return sorted(spans, key=lambda s: s[1])


_LOW_WORD = re.compile(r"(?i)\b(?:the|a|an|of|in|on|to|with|by|for|files?|rows?|ms|turns?|tokens?|events?|vectors?|records?|chunks?|sessions?|lookups?|were|was|is|ticks?|steps?|more|times?|old|new)\b")


def _low_address(text: str, m: re.Match) -> bool:
    street = m.group("c")
    words = street.split()
    if _LOW_WORD.search(" ".join(words[:-1])) and words[0] != "old" and not re.match(r"(?:rue|calle|via|boulevard|chemin)\b", street):
        return False
    if re.fullmatch(_TYPE, words[-1]) and words[-1] in ("way", "view", "place", "park", "green", "gate", "row", "hill", "walk", "close", "rise", "drive", "lane"):
        before = text[max(0, m.start() - 24) : m.start()].lower()
        return bool(re.search(r"(?:\b(?:at|to|in|au|address:?|site:|moved to|stands in|disk to)|->|addr=|; |, |^|\n)\s*$", before)) or len(words) > 2
    return True


def _plausible_id(v: str, whole: str) -> bool:
    digits = sum(c.isdigit() for c in v)
    return digits >= 2 and len(v.replace(" ", "").replace("-", "")) >= 6 and not re.fullmatch(r"\d{1,2} [A-Z]?\w*", v)


def _places(text: str, low: str, names: set[str]) -> list[tuple[int, int]]:
    """Where the given ``names`` stand as whole words, in order."""
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out = []
    for name in names:
        at = low.find(name)
        while at >= 0:
            end = at + len(name)
            before, after = text[at - 1 : at], text[end : end + 1]
            if not (before.isalnum() or before in _BESIDE and before) and not (after.isalpha() or after in _WITHIN and after or unicodedata.category(after or " ")[0] == "M"):
                out.append((at, end))
            at = low.find(name, end)
    return sorted(out)


def _names(text: str, low: str, spans: list, given: frozenset[str]) -> None:
    known = given.intersection(_ANY_WORD.findall(low))
    if known and "," in text:
        for m in _COMMA.finditer(text, overlapped=True):
            if m.group("g").lower() in given and m.group("g")[0].isupper() and _surname(m.group("s").split()[-1], False):
                _add(spans, "name", *m.span(), text)
    for start, stop in _places(text, low, known) if known else ():
        g = text[start:stop]
        if not g[0].isupper() and not g.islower():
            continue
        lower = g.islower()
        at = end = stop
        found = False
        for _ in range(3):
            r = _REST.match(text, at)
            if not r:
                break
            w = r.group("s")
            if len(w) == 1 and w.isupper() and text[r.end() : r.end() + 1] == "." and not lower:
                end, found = r.end() + 1, True
                break
            if w.lower() in given and (w[0].isupper() != lower):
                at = end = r.end()
                found = found or True
                continue
            if _surname(w, lower):
                end, found = r.end(), True
            break
        init = regex.compile(r"[ \t]+(\p{Lu})\.(?!\p{L}{1,2}\.)").match(text, stop)
        if not found and init and not lower:
            end, found = init.end(), True
        if found:
            _add(spans, "name", start, end, text)
    for m in _TITLE.finditer(text):
        n = m.group("n")
        while n and not _surname(regex.split(r"\s", n)[-1], False):
            n = n.rpartition(" ")[0].rstrip()
        if n and not (len(n.split()) > 1 and all(w.lower() in PARTICLES for w in n.split())):
            _add(spans, "name", m.start(), m.start("n") + len(n), text)
    if "." in text:
        for m in _INITIAL.finditer(text):
            s = m.group("s")
            if not _surname(s, False) or _CAMEL.search(s) and not s.startswith(("Mac", "Mc")):
                continue
            _add(spans, "name", *m.span(), text)
    if not text.isascii():
        for m in _FOREIGN.finditer(text):
            _add(spans, "name", *m.span(), text)
    for m in _CARRIER.finditer(text) if next(_CARRIER_SIGNS.iter(low), None) else ():
        ws = m.group("n").split()
        if all(_surname(w, False) or w.lower().rstrip(".") in ("van", "von", "de", "del", "di", "da", "la", "le", "der", "den", "al", "du") for w in ws) and not any(_CAMEL.search(w) and not w.startswith(("Mac", "Mc")) for w in ws):
            _add(spans, "name", *m.span("n"), text)
    m = _TWO.search(text)
    while m:
        if _acting(text, m):
            _add(spans, "name", *m.span(), text)
        m = _TWO.search(text, m.start() + len(m.group().split()[0]))


def _acting(text: str, m: re.Match) -> bool:
    """Whether two capitalized words do, or suffer, what people do."""
    a, b = m.span()
    if not _THEN.match(text, b) and (not _BEFORE.search(text, max(0, a - 24), a) or text[b : b + 1] in ("(", "-", "_") or _MORE.match(text, b)):
        return False
    ws = m.group().split()
    named = all(_surname(w, False) or len(w) == 2 for w in ws if w[0].isupper()) and not any(_CAMEL.search(w) for w in ws)
    return named and ws[0].lower() not in _NO_FIRST and text[max(0, a - 4) : a].lower() not in ("the ", "der ", "die ", "das ")


_JSON_STRING = re.compile(r'"(?:[^"\\]|\\.)*+"(?P<key>\s*:)?')


def field_strings(text: str, is_json: bool) -> list[tuple[int, int, str]]:
    """(start, end, decoded text) of the strings to scan: the string values (not the keys) of a JSON text, or the text itself."""
    if is_json and text.lstrip()[:1] in "{[":
        try:
            json.loads(text, strict=False)
        except ValueError:
            return [(0, len(text), text)]
        return [(*m.span(), json.loads(m.group(), strict=False)) for m in _JSON_STRING.finditer(text) if m.group("key") is None]
    return [(0, len(text), text)]


def _fields(memory: DataFrame, turns: DataFrame) -> DataFrame:
    """Distinct (table_name, row_key, field_name, body) of all four fields."""
    pick = lambda t, key, pairs: F.explode(F.array(*[F.struct(F.lit(t).alias("table_name"), F.col(key).alias("row_key"), F.lit(n).alias("field_name"), F.col(c).cast("string").alias("body")) for n, c in pairs]))
    one = memory.select(pick("memory_records", "id", [("content.text", "content.text"), ("content.structured", "content.structured")]).alias("r"))
    two = turns.select(pick("session_turns", "id", [("user_text", "user_text"), ("assistant_text", "assistant_text")]).alias("r"))
    return one.unionByName(two).select("r.*").where("body is not null and body <> '' and row_key is not null")


NAMES = ["table_name", "row_key", "field_name"]
FOUND = "table_name string, row_key string, field_name string, body string, piece array<int>, start array<int>, stop array<int>, kind array<string>, parts array<string>"


def detect(fields: DataFrame, placeholders: bool = False) -> DataFrame:
    """One row per field that holds entities: the field, per entity its string in the field, its place there and its kind, and the distinct parts of them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FOUND.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            keep: list[int] = []
            for i, (field, body) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                at = [(n, *e, s) for n, (_, _, s) in enumerate(field_strings(body, field == "content.structured")) for e in find_entities(s)]
                if at:
                    parts = {p for _, kind, a, b, s in at for p in ([mark_of(kind, s[a:b])] if placeholders else parts_of(kind, s[a:b]))}
                    rows.append(([x[0] for x in at], [x[2] for x in at], [x[3] for x in at], [x[1] for x in at], sorted(parts)))
                    keep.append(i)
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.list_(pa.int32())] * 3 + [pa.list_(pa.string())] * 2
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(keep, pa.int64())) for i in range(4)], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)

    return spread(fields).mapInArrow(run, FOUND)


def _drawn(key: str, attempt: int):
    @F.pandas_udf("string")
    def drawn(part: pd.Series) -> pd.Series:
        return pd.Series([draw(p, key, attempt) for p in part])

    return drawn("part")


def redrawn_parts(parts: DataFrame, key: str, rounds: int = 24) -> DataFrame | None:
    """(part, attempt) of the distinct ``parts`` (part) whose first draw will not do; None if there are none.

    Of parts that meet on one surrogate all but the least are drawn again, and so is each whose surrogate is itself a part that occurs:
    no two entities become one, and none becomes another real one. Only the clashing parts go from round to round.
    """
    kind = F.substring_index("part", ":", 1)
    real = parts.select(kind.alias("kind"), F.expr("substring(part, instr(part, ':') + 1)").alias("surrogate"))
    first = materialize(parts.withColumn("kind", kind).withColumn("surrogate", _drawn(key, 0)), "pii-draw")

    def clashing(tried: DataFrame, taken: list[DataFrame]) -> DataFrame:
        met = tried.groupBy("kind", "surrogate").agg(F.min("part").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        out = tried.join(met, ["kind", "surrogate"]).where("part <> least").select("part")
        for other in taken:
            out = out.unionByName(tried.join(other.select("kind", "surrogate"), ["kind", "surrogate"], "left_semi").select("part"))
        return out.distinct()

    todo = materialize(clashing(first, [real]), "pii-open")
    done = None
    for attempt in range(1, rounds):
        if todo.isEmpty():
            return done if done is None else done.select("part", "attempt")
        tried = materialize(todo.withColumn("kind", kind).withColumn("surrogate", _drawn(key, attempt)).withColumn("attempt", F.lit(attempt)), "pii-draw")
        todo = materialize(clashing(tried, [real, first] + ([done] if done is not None else [])), "pii-open")
        settled = tried.join(todo, "part", "left_anti")
        done = materialize(settled if done is None else done.unionByName(settled), "pii-given")
    raise RuntimeError("surrogates still collide; use longer ones")


def surrogates(entities: DataFrame, key: str, rounds: int = 24) -> DataFrame:
    """``part`` and ``surrogate`` for every distinct part in the ``parts`` of ``entities``, with no surrogate given twice within a kind."""
    parts = materialize(entities.select(F.explode("parts").alias("part")).distinct(), "pii-parts")
    again = redrawn_parts(parts, key, rounds)
    first = parts.withColumn("surrogate", _drawn(key, 0))
    if again is None:
        return first

    @F.pandas_udf("string")
    def redrawn(part: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([draw(p, key, int(n)) for p, n in zip(part, attempt, strict=True)])

    return first.join(again, "part", "left_anti").unionByName(again.select("part", redrawn("part", "attempt").alias("surrogate")))


def replaced_text(body: str, is_json: bool, at: list[tuple[int, int, int, str]], change) -> str:
    """``body`` with ``change(kind, value)`` in place of each entity (string, start, stop, kind) and every other character as it was."""
    strings = field_strings(body, is_json)
    out, last = [], 0
    for n, spans in itertools.groupby(at, key=lambda e: e[0]):
        a, b, s = strings[n]
        parts, end = [], 0
        for _, x, y, kind in spans:
            parts += [s[end:x], change(kind, s[x:y])]
            end = y
        new = "".join([*parts, s[end:]])
        whole = (a, b) == (0, len(body)) and s == body
        out += [body[last:a], new if whole else json.dumps(new, ensure_ascii=body[a:b].isascii())]
        last = b
    return "".join([*out, body[last:]])


def replace_personal(memory: DataFrame, turns: DataFrame, key: str, placeholders: bool = False) -> DataFrame:
    """Every field that holds an entity, rewritten: table_name, row_key, field_name, body, and the ``kinds`` of the entities that were replaced.

    The texts are searched once. The distinct parts of all entities are drawn for and checked as a table; a task draws for the parts of
    its own fields again, which is cheaper than a join, and only fields with a part that had to be drawn anew are joined to these few.
    With ``placeholders`` an entity becomes ``[KIND_xxxxxxxx]`` with a mark that is equal for equal entities and for these only.
    ``key`` is secret: who knows it can tell whether a given entity became a given surrogate.
    """
    if not key:
        raise ValueError("a secret key is needed")
    found = materialize(detect(_fields(memory, turns), placeholders), "pii-found")
    again = redrawn_parts(materialize(found.select(F.explode("parts").alias("part")).distinct(), "pii-parts"), key)
    if again is None:
        rows = found.withColumn("attempts", F.lit(None).cast("map<string,int>"))
    else:
        # One field holds few entities: its part list is bounded by its own text.
        same = F.xxhash64(*NAMES, "body")
        per = found.select(same.alias("_h"), *[F.col(c).alias(f"_{c}") for c in NAMES], F.explode("parts").alias("part")).distinct().join(again, "part")
        per = per.groupBy("_h", *[f"_{c}" for c in NAMES]).agg(F.map_from_entries(F.collect_list(F.struct("part", "attempt"))).alias("attempts"))
        rows = found.withColumn("h", same).join(per, [F.col("h") == F.col("_h"), *[F.col(c) == F.col(f"_{c}") for c in NAMES]], "left")
        rows = rows.select(*found.columns, "attempts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, str] = {}
            bodies, kinds = [], []
            columns = [batch.column(i).to_pylist() for i in (2, 3, 4, 5, 6, 7, 9)]
            for field, body, piece, start, stop, kind, attempts in zip(*columns, strict=True):
                tries = dict(attempts or ())
                gone: set[str] = set()

                def surrogate(part: str, tries: dict = tries) -> str:
                    if part in tries:
                        return draw(part, key, tries[part])
                    if part not in known:
                        known[part] = draw(part, key, 0)
                    return known[part]

                def change(k: str, value: str, gone: set = gone, surrogate=surrogate) -> str:
                    new = surrogate(mark_of(k, value)) if placeholders else rewrite(k, value, key, surrogate)
                    if new != value:
                        gone.add(k)
                    return new

                bodies.append(replaced_text(body, field == "content.structured", list(zip(piece, start, stop, kind, strict=True)), change))
                kinds.append(sorted(gone))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(bodies, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=[*NAMES, "body", "kinds"])

    return rows.mapInArrow(run, "table_name string, row_key string, field_name string, body string, kinds array<string>")


def find_personal(memory: DataFrame, turns: DataFrame, key: str) -> DataFrame:
    """Distinct (table_name, row_key, field_name, kind) of the entities that were replaced."""
    return replace_personal(memory, turns, key).select(*NAMES, F.explode("kinds").alias("kind")).distinct()


def redact_personal(memory: DataFrame, turns: DataFrame, key: str, placeholders: bool = False) -> DataFrame:
    """The distinct rewritten fields: table_name, row_key, field_name, body."""
    return replace_personal(memory, turns, key, placeholders).select(*NAMES, "body").distinct()
