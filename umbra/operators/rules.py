"""Detection rules as data, and the compiler that makes patterns portable.

A rule names its class, pattern, the capture groups that give the span (the first non-empty one), validator and what
its failure does, locale and its basis, priorities, exclusions, reject guard, and its collision family.
"""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field

import regex

from umbra.functions.validators import IBAN_LENGTHS

TOKEN_SAMPLES = ("<0a1b2c3d:Email_1>", "<0a1b2c3d:Name_12>", "<0a1b2c3d:Custom:iban_3>", "<0a1b2c3d:Custom:family:payment-card-or-iban_2>", "0a1b2c3d:name_4", "[REDACTED]", "[EMAIL]")


@dataclass(frozen=True)
class Rule:
    id: str
    cls: str
    pattern: str
    groups: tuple[int, ...] = (0,)
    validator: str | None = None
    on_fail: str = "veto"
    locales: tuple[str, ...] = ("global",)
    basis: str = "document"
    tier: str = "safe_default"
    base: float = 0.7
    priority: int = 80
    family: str | None = None
    variant: str | None = None
    precedence: int = 0
    anchors: tuple[str, ...] = ()
    exclusions: tuple[str, ...] = ()
    reject: str | None = None
    normalizer: str | None = None
    complete: bool = False
    needs: tuple[str, ...] = ()  # every one must be in the text
    hints: tuple[str, ...] = ()  # one of them must be in the lower-cased text
    digits: bool = False  # an ASCII digit must be in the text: no match is without one
    word_run: bool = False  # what follows must not be more of an identifier
    zero_country: bool = False  # not the rest of a number that starts +0
    sku: bool = False  # not inside a stock-keeping number
    card_run: bool = False  # the match is a digit run to be searched for cards
    compiled: object = field(default=None, compare=False)


def compile_pattern(pattern: str):
    """Reference dialect to the ``regex`` module: code point escapes become literals, ASCII word edges look-around."""
    out = re.sub(r"\\[xu]\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern)
    out = out.replace(r"(?-u:\b)", r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))")
    return regex.compile(out.replace(r"\z", r"\Z"), regex.V1)


# Separators that detection accepts between a cue and its value, and words that may fill the gap.
_LINK = r"""\s*(?:\\?["'])?\s*[:=#-]?\s*(?:\\?["'])?"""
_FILLERS = "number|numbers|nummer|nummern|num|no|nr|id|code|is|was|ist|war|lautet|lauten|of|with|mit|der|dem|den|die|das|my|your|his|her|their|the|und|and|under|unter|registered"
_FILL = rf"(?:\s*[,:;(_-]?\s*(?:{_FILLERS})\b\.?){{0,4}}\s*(?:\\?[\"'])?\s*[:=#|/,.;-]?\s*(?:\\?[\"'])?"
_END = r"(?![0-9A-Za-z])"
_PHONE = {"family": "phone-or-imei", "variant": "phone", "precedence": 10}
_NAME = r"\p{Lu}[\p{L}\p{M}]*(?:['’-]\p{L}[\p{L}\p{M}]*)*(?:\s+\p{Lu}[\p{L}\p{M}]*(?:['’-]\p{L}[\p{L}\p{M}]*)*){0,3}"
_HEADERS = "From|To|Cc|Bcc|Reply-To|Sender|Von|An|Antwort-An|Absender"
_NANP = r"(?:\+?1[\s.-]+(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})[\s.-]*[2-9][0-9]{2}[\s.-]*[0-9]{4}|\([2-9][0-9]{2}\)[\s.-]*[2-9][0-9]{2}[\s.-]*[0-9]{4}|[2-9][0-9]{2}[\s.-]+[2-9][0-9]{2}[\s.-]+[0-9]{4}|555[\s.-]*01[0-9]{2})"
_LABELS = r"(?i:\b(?:phone(?:[ \t_-]?(?:number|num|no))?|telefon|telephone|tel|handy|mobile|mobilnummer|rufnummer|call)\b)\.?[ \t]*[\"']?[ \t]*(?:[,=:]|(?:on|at|is)\b)?[ \t]*[\"']?[ \t]*"
_LEFT = r"(?<![\p{L}\p{N}_+])"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_CALENDAR = r"[0-9]{4}([-/.])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])"
_DAY, _MONTH = "(?:0?[1-9]|[12][0-9]|3[01])", r"\p{L}{3,10}"
_DATES = rf"[0-9]{{4}}-(?:0[1-9]|1[0-2])-{_DAY}|[0-9]{{4}}/(?:0[1-9]|1[0-2])/{_DAY}|[0-9]{{4}}\.(?:0[1-9]|1[0-2])\.{_DAY}|{_DAY}\.(?:0?[1-9]|1[0-2])\.(?:[0-9]{{4}}|[0-9]{{2}})|{_DAY}-(?:0?[1-9]|1[0-2])-(?:[0-9]{{4}}|[0-9]{{2}})|[0-9]{{1,2}}/[0-9]{{1,2}}/(?:[0-9]{{4}}|[0-9]{{2}})|{_DAY}(?:st|nd|rd|th)?\.?\s+(?:of\s+)?{_MONTH}\.?,?\s+[0-9]{{4}}|{_MONTH}\.?\s+{_DAY}(?:st|nd|rd|th)?,?\s+[0-9]{{4}}"
_AGE = "(?:1[01][0-9]|12[0-2]|[1-9]?[0-9])"
_IS_DATE = r"(?:19|20)[0-9]{2}[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)[0-9]{2}"
_DACH, _EN = ("de-DE", "de-AT", "de-CH"), ("en-US", "en-GB", "en-IE", "en-AU", "en-CA")


def iban_pattern(known: bool = True) -> str:
    """Two letters, two digits and as many characters, in groups of four, as the country's numbers have; or the shape
    of an account number of a country that is not in the registry."""
    if not known:
        return rf"(?!(?:{'|'.join(sorted(IBAN_LENGTHS))}))[A-Z]{{2}}[0-9]{{2}}(?:[A-Z]{{0,4}}[0-9]{{6,26}}|(?:[ -][A-Z]{{1,4}})?(?:[ -][A-Z]*[0-9][A-Z0-9]*){{3,8}})"
    by_length: dict[int, list[str]] = {}
    for country, n in sorted(IBAN_LENGTHS.items()):
        by_length.setdefault(n, []).append(country)
    arms = []
    for n, countries in sorted(by_length.items()):
        fours, rest = divmod(n - 4, 4)
        arms.append(rf"(?:{'|'.join(countries)})[0-9]{{2}}(?:[ -]?[A-Z0-9]{{4}}){{{fours}}}" + (rf"[ -]?[A-Z0-9]{{{rest}}}" if rest else ""))
    return f"(?:{'|'.join(arms)})"


def _cued(id_: str, cls: str, cue: str, value: str, hints: tuple[str, ...], fill: str = _FILL, **more) -> Rule:
    return Rule(id_, cls, rf"(?i)(?:\b|_)(?:{cue}){fill}({value}){_END}", (1,), **({"base": 0.85, "priority": 84, "hints": hints, "digits": True} | more))


def _national(id_: str, cls: str, cue: str, value: str, hints: tuple[str, ...], locales: tuple[str, ...], **more) -> Rule:
    return _cued(id_, cls, cue, value, hints, _LINK, **({"locales": locales, "basis": "format", "base": 0.88, "priority": 86} | more))


#: The rule pack: identifiers by structure and checksum, values after cues, names after headers.
#: Ids, classes, cue words, value shapes, scores and priorities, which results depend on.
CORE: tuple[Rule, ...] = (
    Rule("email.global", "email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9_])", validator="email_rfc", priority=90, normalizer="email", exclusions=("test.local",), needs=("@",)),
    Rule("email.header.name", "name", rf"(?m)^(?:{_HEADERS}):\s*(?:\"([^\"\n]+)\"|({_NAME}))\s+<[^>\n]+>", (1, 2), base=0.85, priority=100, needs=("<", "@")),
    Rule("email.header.name.paren", "name", rf"(?:(?:{_HEADERS}):|,)\s*\S+@\S+\s*\(([^)\n]+)\)", (1,), base=0.85, priority=100, needs=("@", "(")),
    Rule("phone.structural", "custom:phone", rf"{_LEFT}\+[1-9][0-9]{{5,14}}(?![0-9A-Za-z_])", validator="e164_phone", digits=True, needs=("+",), **_PHONE),
    Rule("phone.e164.spaced", "custom:phone", rf"{_LEFT}((?:\+(?:[235-9][0-9]{{0,2}}|4(?:[0-8][0-9]?|9[0-9]?))|00[1-9][0-9]{{0,2}})[\s./-]+(?:\(0\)[\s./-]*)?(?:[0-9][\s./-]?){{6,14}}[0-9])(?![0-9A-Za-z_])", (1,), "phone_number", priority=79, reject=r"(?i).*\b(?:firmware|build|version|release|part|model)\b.*", digits=True, **_PHONE),
    Rule("phone.e164.spaced.cued", "custom:phone", rf"{_LABELS}((?:\+|00)[1-9][0-9]{{0,2}}[ ./-]*(?:\(0\)[ ./-]*)?[0-9](?:[ ./-]*[0-9]){{6,14}}|[0-9](?:[ ./-]*[0-9]){{7,14}})(?![0-9A-Za-z_])", (1,), "phone_number", "record", priority=78, digits=True, hints=("phone", "telefon", "tel", "handy", "mobil", "rufnummer", "call"), **_PHONE),
    Rule("phone.national.de", "custom:phone", rf"{_LEFT}((?:\+49[\s.-]*|0)[1-9][0-9]{{1,4}}[\s./-]*[0-9](?:[\s./-]*[0-9]){{4,10}})(?![0-9A-Za-z_])", (1,), "e164_phone_national_de", locales=_DACH, tier="locale_gated", base=0.82, priority=85, digits=True, zero_country=True, **_PHONE),
    Rule("phone.national.us", "custom:phone", rf"{_LEFT}({_NANP})(?![0-9A-Za-z_])", (1,), "e164_phone_national_us", locales=("en-US",), basis="format", base=0.82, priority=85, digits=True, zero_country=True, **_PHONE),
    Rule("phone.national.us.cued", "custom:phone", rf"{_LABELS}({_NANP})(?![0-9A-Za-z_])", (1,), "e164_phone_national_us", "record", locales=("en-US",), basis="format", base=0.82, priority=79, digits=True, hints=("phone", "telefon", "tel", "handy", "mobil", "rufnummer", "call"), **_PHONE),
    Rule("iban.structural", "custom:iban", rf"(?<![A-Za-z0-9_]){iban_pattern()}", validator="iban_mod97", on_fail="record", normalizer="iban", family="payment-card-or-iban", variant="iban", precedence=10, anchors=("iban", "konto", "account", "bankverbindung"), digits=True, word_run=True),
    Rule("iban.cued", "custom:iban", rf"(?i:\biban(?:[ _-]?(?:number|no|nr|nummer|code))?\b)\.?[\"' ]*[:,=]?[^0-9\n.;!?:,=]{{0,32}}?\b({iban_pattern(False)}){_END}", (1,), "iban_mod97", "record", normalizer="iban", digits=True, hints=("iban",)),
    Rule("card.structural", "custom:credit_card", r"(?<![0-9A-Za-z_])[0-9](?:[\s-]?[0-9])*(?![0-9A-Za-z_])", validator="luhn", family="payment-card-or-iban", variant="pan", precedence=20, digits=True, card_run=True),
    Rule("card.cued", "custom:credit_card", r"(?i:\b(?:(?:credit|debit|payment|bank|prepaid|gift)[ _-]?)?cards?(?:[ _-]?(?:number|num|no|nr|holder))?\b|\b(?:kredit|debit|bank|ec|giro|geld)?-?karten?(?:nummer|nr)\b|\bkreditkarte\b|\b(?:visa|mastercard|amex|american express|maestro|diners(?: club)?|jcb|unionpay|girocard)\b)\.?[\"' ]*[:,=]?[^0-9\n.;!?:,=]{0,32}?\b([0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}(?:[ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[2-6][0-9]{15,18}|3[0-9]{13,14})(?![0-9]|[ -][0-9])", (1,), "luhn", "record", digits=True, hints=("card", "karte", "visa", "amex", "american express", "maestro", "diners", "jcb", "unionpay")),
    Rule("card.cued_short", "custom:credit_card", r"(?i:\b(?:(?:credit|debit|payment|bank|prepaid|gift)[ _-]?)?cards?(?:[ _-]?(?:number|num|no|nr))?\b|\bkarten?(?:nummer|nr)\b|\bmaestro\b)\.?[\"' ]*[:=]?[\"' ]*(?i:(?:is|ist|lautet) +)?((?:5[06-9]|6[0-9])[0-9]{2}[ -][0-9]{4}[ -][0-9]{4}|(?:5[06-9]|6[0-9])[0-9]{10,13})(?![0-9]|[ -][0-9])", (1,), "luhn", "record", digits=True, hints=("card", "karte", "maestro")),
    Rule("ip.v4", "custom:ip_address", rf"(?<![0-9A-Za-z_.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z_]|\.[0-9])", validator="ipv4_parse_non_documentation", needs=(".",), digits=True),
    Rule("ip.v6", "custom:ip_address", r"(?<![0-9A-Za-z_:.])(?:[0-9A-Fa-f]{0,4}:){2,7}(?:[0-9A-Fa-f]{1,4}|(?:[0-9]{1,3}\.){3}[0-9]{1,3})?(?![0-9A-Za-z_:])", validator="ipv6_parse_non_documentation", needs=("::",)),
    Rule("eth.address", "custom:eth_address", r"(?<![0-9A-Za-z_])0x[0-9a-fA-F]{40}(?![0-9A-Za-z_])", validator="eth_eip55", needs=("0x",)),
    _national("aadhaar.in", "custom:aadhaar", r"(?:aadhaar|uid|unique[\s_-]*identification|आधार)(?:[\s_-]*(?:number|no\.?|id))?", r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", ("aadhaar", "uid", "unique", "आधार"), ("en-IN", "hi-IN"), validator="aadhaar_verhoeff"),
    _national("nir.fr", "custom:nir", r"n[°º]?\s*ss|nir(?:[_-]?(?:number|num|no))?|s[ée]curit[ée][\s_-]*sociale", r"[123478][0-9](?:[ -]?[0-9]){13}", ("ss", "nir", "sociale"), ("fr-FR",), validator="fr_nir_mod97"),
    _cued("steuer_id.de", "custom:steuer_id", r"steuer[\s_-]?id(?:[_-]?(?:nr|nummer|number|no))?|(?<!fahrzeug)(?<!fahrzeug-)(?:steuer[_-]?|steuerliche\s+)?identifikationsnummer|idnr\.?|tax[_-]?id(?:[_-]?(?:number|no))?", r"[0-9]{2}[ -]?[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{3}", ("steuer", "identifikationsnummer", "idnr", "tax"), validator="de_steuer_id_mod1110", on_fail="record", locales=_DACH, basis="format", base=0.88, priority=86, reject=r"0(?:[ -]?0){10}"),
    _national("vat.de", "custom:vat_id", r"ust[\s._-]*(?:idnr\.?|id)|umsatzsteuer[\s_-]*id|mwst[\s_-]*nr\.?|vat[\s_-]*(?:id|number|no)", "DE[0-9]{9}", ("ust", "umsatzsteuer", "mwst", "vat"), _DACH),
    _national("vat.es", "custom:vat_id", r"nif[\s_-]*iva|cif|nif|iva|vat(?:[\s_-]*id)?", "ES[A-Z0-9][0-9]{7}[A-Z0-9]", ("cif", "nif", "iva", "vat"), ("es-ES",), base=0.84, priority=84),
    _national("bsn.nl", "custom:bsn", r"bsn(?:[_-]?(?:nr|nummer|number|no))?|burger[_-]?service[_-]?nummer", "[0-9]{9}", ("bsn", "burger"), ("nl-NL",), validator="bsn_mod11", on_fail="record", reject="0{9}"),
    _national("cpf.br", "custom:cpf", r"cpf(?:[_-]?(?:number|numero|número|nr|no))?|cadastro\s+de\s+pessoas\s+f[íi]sicas", r"[0-9]{3}\.?[0-9]{3}\.?[0-9]{3}-?[0-9]{2}", ("cpf", "cadastro"), ("pt-BR",), validator="cpf_mod11", on_fail="record"),
    _national("cnpj.br", "custom:cnpj", r"cnpj(?:[_-]?(?:number|numero|número|nr|no))?|cadastro\s+nacional\s+da\s+pessoa\s+jur[íi]dica", r"[0-9]{2}\.?[0-9]{3}\.?[0-9]{3}/?[0-9]{4}-?[0-9]{2}", ("cnpj", "cadastro"), ("pt-BR",), validator="cnpj_mod11"),
    _national("nhs.uk", "custom:nhs_number", r"nhs[\s_-]*(?:number|num|no\.?|id)?", r"[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{4}", ("nhs",), ("en-GB",), validator="uk_nhs_mod11", on_fail="record", reject=r"0(?:[ -]?0){9}"),
    _cued("ssn.us", "custom:ssn", r"ssn|social[\s_-]*security(?:[\s_-]*number)?|ss#", r"[0-9]{3}[-. ][0-9]{2}[-. ][0-9]{4}|[0-9]{9}", ("ssn", "social", "ss#"), locales=("en-US",), basis="format", base=0.88, priority=86),
    _national("nino.uk", "custom:nino", r"nino|ni[\s_-]*number|national[\s_-]*insurance(?:[\s_-]*number)?", r"(?!BG|GB|KN|NK|NT|TN|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\s?[0-9]{2}\s?[0-9]{2}\s?[0-9]{2}\s?[A-D]", ("nino", "ni", "insurance"), ("en-GB",)),
    _national("pan.in", "custom:pan", r"pan(?:[\s_-]*(?:card|no|number))?|permanent[\s_-]+account[\s_-]+number|पैन", "[A-Z]{3}[ABCFGHJLPT][A-Z][0-9]{4}[A-Z]", ("pan", "permanent", "पैन"), ("en-IN", "hi-IN")),
    *(Rule(i, "custom:postal_code", p, g, locales=loc, basis=basis, tier=tier, base=base, priority=prio, digits=True, **more) for i, p, g, loc, basis, tier, base, prio, more in (
        ("postal.de", r"(?<![0-9A-Za-z_])[0-9]{5}(?![0-9A-Za-z_])", (0,), ("de-DE",), "document", "locale_gated", 0.7, 70, {"sku": True}),
        ("postal.us", r"(?<![0-9A-Za-z_])[0-9]{5}(?:-[0-9]{4})?(?![0-9A-Za-z_])", (0,), ("en-US",), "document", "locale_gated", 0.7, 70, {"sku": True}),
        ("postal.at_ch", r"(?i:\b(?:plz|postleitzahl|zip(?:[- ]?code)?))[ \t]*[:#.]?[ ]*(?:(?i:ist|lautet) +)?((?:(?:A|CH|FL)-)?[0-9]{4})\b|(?<![#0-9A-Za-z_])((?:(?:A|CH|FL)-)?[0-9]{4}),?[ ]{1,3}(?=\p{Lu}[\p{L}-]{2,}|St[. ])", (1, 2), ("de-AT", "de-CH"), "document", "locale_gated", 0.7, 70, {}),
        ("postal.au", r"(?<![#\p{L}\p{N}_])\p{Lu}[\p{L}'-]{2,}[ \n,|]{1,4}((?:NSW|VIC|QLD|SA|WA|TAS|NT|ACT)[ \n,|]{1,4}[0-9]{4})(?![0-9A-Za-z_])", (1,), ("en-AU",), "document", "locale_gated", 0.7, 70, {}),
        ("postal.ca", r"(?<![#0-9A-Za-z_])[A-Z][0-9][A-Z](?: {1,2}|-)?[0-9][A-Z][0-9](?![0-9A-Za-z_])", (0,), ("en-CA",), "format", "safe_default", 0.8, 72, {}),
        ("postal.gb", r"(?<![#0-9A-Za-z_])(?:GIR {0,2}0AA|[A-Z]{1,2}[0-9][A-Z0-9]? {0,2}[0-9][ABD-HJLNP-UW-Z]{2})(?![0-9A-Za-z_])", (0,), ("en-GB",), "format", "safe_default", 0.8, 72, {"word_run": True}),
        ("postal.ie", r"(?<![0-9A-Za-z_])(?:[AC-FHKNPRTV-Y][0-9]{2}|D6W) {0,2}(?=[0-9]{0,3}[AC-FHKNPRTV-Y])[0-9AC-FHKNPRTV-Y]{4}(?![0-9A-Za-z_])", (0,), ("en-IE",), "format", "safe_default", 0.8, 72, {}),
    )),
    Rule("postal.cued_four_digit", "custom:postal_code", r"(?i)\b(?:postcode|postal[ \t_-]*code|zip(?:[ \t_-]*code)?)\b[ \t:=\"'-]*(?:is +)?([0-9]{4})(?![0-9A-Za-z_])", (1,), priority=70, digits=True, hints=("post", "zip")),
    Rule("postal.cued_short", "custom:postal_code", r"(?i)\b(?:zip(?:[ \t_-]*code)?|post[ \t_-]*code|postal[ \t_-]*code|plz|postleitzahl|cep|postnummer|kod pocztowy|code postal)\b[ \t:=\"'-]*(?:(?:is|ist|lautet) +)?([1-9][0-9]{2} [0-9]{2}|[0-9]{2}-[0-9]{3}|[0-9]{5}-[0-9]{3}|[1-9][0-9]{5}|(?<!plz.{0,9})(?<!zahl.{0,9})[1-9][0-9]{2})(?![0-9]|[ -][0-9])", (1,), priority=70, digits=True, hints=("zip", "post", "plz", "cep", "pocztowy")),
    Rule("url.anchored", "custom:url", r"(?i)(?<![A-Za-z0-9])(?:https?://|www\.)[^\s\"<>{}\\']*[^\s\"<>{}\\.,;:!?)\]']", base=0.75, priority=85, hints=("http", "www.")),
    _cued("ssn.de_cue", "custom:ssn", r"sozialversicherung(?:s[_-]?(?:nummer|ausweis))?|sv[_-]?nummer|social[\s_-]*insurance(?:[\s_-]*number)?|ahv(?:[\s_-]*(?:number|nummer))?", r"[0-9]{3}[-. ][0-9]{2}[-. ][0-9]{4}|[0-9]{3}[.-][0-9]{4}[.-][0-9]{4}[.-][0-9]{2}|[0-9]{9,11}", ("sozialversicherung", "sv", "social", "ahv"), locales=_DACH, basis="format", base=0.88, priority=86, family="government-id", variant="ssn", precedence=10),
    _cued("tax_number.cue_anchored", "custom:tax_number", r"steuer(?:[_-]?id|[_-]?nummer)?|idnr\.?|tax(?:[ \t_-]?(?:id|number))?|taxpayer|tin", r"[0-9]{3}[ ./-][0-9]{2,4}[ ./-][0-9]{2,4}(?:[ ./-][0-9]{2,4})?", ("steuer", "idnr", "tax", "tin"), complete=True, family="government-id", variant="tax-number", precedence=20),
    _cued("driver_license.cue_anchored", "custom:driver_license", r"driver'?s?[ \t_-]?licen[cs]e|driving[ \t_-]?licen[cs]e|licen[cs]e[ \t_-]?number|dl#|f[uü]hrerschein(?:[_-]?nummer)?|fahrerlaubnis", r"[A-Z]{1,3}-?[0-9]{5,12}", ("licen", "dl#", "hrerschein", "fahrerlaubnis"), complete=True, priority=83),
    _cued("national_id.cue_anchored", "custom:national_id", r"national[ \t_-]?id(?:entity|entification)?(?:[ \t_-]?(?:number|nummer))?|identity[ \t_-]?(?:card|number)|id[ \t_-]?(?:card|number|nummer|karte)|identit[äa]tskarte|personalausweis(?:es|nummer)?|ahv(?:-?nummer)?", r"[A-Z]{1,3}[0-9][A-Z0-9]{5,11}|[0-9]{2,4}(?:[ .-][0-9]{2,4}){2,3}|756\.[0-9]{4}\.[0-9]{4}\.[0-9]{2}|[0-9]{9,13}", ("national", "identity", "id", "identit", "personalausweis", "ahv"), complete=True, base=0.82, priority=82, family="government-id", variant="national-id", precedence=30, reject=_IS_DATE),
    _cued("passport.cue_anchored", "custom:passport", r"passports?(?:[ \t_-]?id)?|reisep[aä]ss(?:e?s|[_-]?nummer|[_-]?nr\.?)?|passnummer", r"[A-Z]{1,3}-?[0-9]{6,9}[A-Z]{0,2}|[A-Z][0-9]{2}[A-Z][0-9]{5,6}|[0-9]{2}[A-Z][0-9]{6}|[A-Z][0-9]{2}[A-Z][0-9][A-Z][0-9][A-Z][0-9]|[0-9]{9}", ("passport", "reisep", "passnummer"), family="government-id", variant="passport", precedence=15),
    *(_cued(i, c, cue, r"[A-Z]{1,4}[0-9][A-Z0-9]{1,5}(?:[ ./_:-][A-Z0-9]{3,6}){1,2}|[0-9]{2,4}[A-Z]{1,3}[ /_:-]?[0-9]{2,6}|[A-Z]{1,4}-?[0-9][A-Z0-9]{5,13}|[0-9]{2,4}(?:[ ./_:-][0-9]{2,4}){2,3}|[0-9]{6,12}", hints, base=0.84, priority=84, complete=True, reject=_IS_DATE, **more) for i, c, cue, hints, more in (
        ("tax_number.labelled", "custom:tax_number", r"tax(?:[ _-]?payer)?(?:[ _-]?identification)?[ _-]?(?:number|no\.?|id)|utr|tfn|steuer[ _-]?nummer|num[eé]ro[ _-]fiscal", ("tax", "utr", "tfn", "steuer", "fiscal"), {"family": "government-id", "variant": "tax-number", "precedence": 20}),
        ("driver_license.labelled", "custom:driver_license", r"driver'?s?[ _-]?licen[cs]e(?:[ _-]?(?:number|no\.?|nr\.?|id))?|driving[ _-]?licen[cs]e(?:[ _-]?(?:number|no\.?|id))?|f[uü]hrerschein(?:[ _-]?(?:nummer|nr\.?))?|rijbewijs|permis[ _-]de[ _-]conduire", ("licen", "hrerschein", "rijbewijs", "permis"), {}),
        ("id_card.labelled", "custom:national_id", r"national[ _-]?(?:id|identification)(?:[ _-]?(?:number|no\.?|nr\.?))?|id[ _-]?card(?:[ _-]?(?:number|no\.?|nr\.?|id))?|identity[ _-]?card(?:[ _-]?(?:number|no\.?|id))?|personalausweis(?:[ _-]?(?:nummer|nr\.?))?|carte[ _-]d['’]identit[eé]", ("national", "id", "identity", "personalausweis", "carte"), {"family": "government-id", "variant": "national-id", "precedence": 30}),
    )),
    Rule("birth_date.cue", "custom:birth_date", rf"(?i)(?:\b|_)(?:(?:dob|date[ _-]?of[ _-]?birth|birth[ _-]?date|birth[ _-]?day|born|geburts[ _-]?datum|geburtstag|geboren|geboortedatum|date[ _-]de[ _-]naissance|data[ _-]de[ _-]nascimento|née|né|fødselsdato|født|fecha[ _-]de[ _-]nacimiento|nacid[oa])\b|d\.o\.b\.?|geb\.)(?:[\s\"'\\:=,()–-]+|(?:is|was|ist|war|lautet|wurde|am|on|of|the|le|est|op|el|es|at)\b){{0,8}}({_DATES})(?![0-9])", (1,), base=0.9, priority=100, digits=True, hints=("dob", "birth", "born", "geb", "naissance", "nascimento", "né", "fød", "nacim", "nacid", "d.o.b")),
    Rule("birth_date.answer", "custom:birth_date", rf"(?i)(?:\b|_)(?:dob|date[ _-]?of[ _-]?birth|birth[ _-]?date|birthday|geburts[ _-]?datum|geburtstag)\b[ \t]*[?.!]+[\"'’)\]]*\s+(?:it[’']?s|it\s+is|that[’']?s|es\s+ist|das\s+ist)(?:\s+(?:der|den|am|on|the))?\s+({_DATES})(?![0-9])", (1,), base=0.9, priority=100, digits=True, hints=("dob", "birth", "geburt")),
    Rule("age.cue", "custom:age", rf"(?i)\b(?:age|aged|âge|idade|leeftijd|alter)\b[ \"']*[:=]?\s*({_AGE})(?![0-9]|[.,][0-9])", (1,), base=0.9, priority=100, digits=True, hints=("age", "âge", "idade", "leeftijd", "alter")),
    Rule("age.phrase", "custom:age", rf"(?i)\b{_AGE}[ -]+(?:years?|yrs?)[ -]+old[ -]+(?:fe)?male[ -]+(?:cat|kitten|dog|puppy|horse|pony|mare|cow|bull|goat|sheep|pig|rabbit|parrot|bird)\b|(?<![0-9.,])({_AGE})(?:[ -]+(?:years?|yrs?)[ -]+old\b| Jahre alt\b| ans\b| años\b| y/o\b)|\b(?:at the age of|im Alter von) ({_AGE})(?![0-9])", (1, 2), base=0.9, priority=100, digits=True, hints=("old", "jahre", " ans", "años", "y/o", "age of", "alter von")),
    Rule("security_token.anchored", "custom:security_token", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}|(?i:\b(?:bearer|authorization|api[ _-]?key|access[ _-]?token|secret)\b)[\s:=\"']{1,4}([A-Za-z0-9_+/=-]{20,})(?![A-Za-z0-9])", (1, 0), priority=87, base=0.85, hints=("akia", "eyj", "bearer", "authorization", "api", "access", "secret")),
    Rule("security_token.code", "custom:security_token", r"(?i:(?<![A-Za-z0-9])(?:api[_-]?(?:key|token)|remember[_-]?token|security[_-]?token|access[_-]?(?:token|key)|auth(?:orization)?[_-]?token|secret|token))[\"']?\s*(?:=>|[:=])\s*[\"']([A-Za-z0-9+/_.=-]{8,})[\"']", (1,), priority=100, base=0.9, hints=("api", "token", "secret", "access")),
    Rule("password.field", "custom:password", r"(?i:\b(?:password|passwd|passphrase|passwort|kennwort)\b)[\"']?\s*[:=]\s*([^\s\"',;]{4,})", (1,), priority=100, base=0.9, hints=("passw", "passphrase", "kennwort")),
    Rule("password.code", "custom:password", r"(?i:\b(?:password|passwd|passwort|kennwort)\b)[\"']?\s*(?:=>|[:=])\s*[\"']([^\"'\n]{1,})[\"']", (1,), priority=100, base=0.9, hints=("passw", "kennwort")),
    Rule("password.hash", "custom:password", r"\$2[abxy]\$[0-9]{2}\$[./A-Za-z0-9]{53}|\$argon2(?:id|i|d)\$v=19\$m=[0-9]+,t=[0-9]+,p=[0-9]+\$[A-Za-z0-9+/]+\$[A-Za-z0-9+/]+|\$[156]\$(?:rounds=[0-9]+\$)?[./A-Za-z0-9]{1,16}\$[./A-Za-z0-9]{22,86}", priority=100, base=0.95, digits=True, needs=("$",)),
    Rule("security_token.bare", "custom:security_token", r"(?<![a-z0-9])(?=\S*[0-9])(?:gh[pousr]_[A-Za-z0-9_-]{36,}|github_pat_[A-Za-z0-9_-]{82,}|sk-(?:proj|svcacct|admin|ant)-[A-Za-z0-9_-]{32,}|sk-[A-Za-z0-9]{32}[A-Za-z0-9_-]*|xox[abprs]-[A-Za-z0-9][A-Za-z0-9-]{9,}|xapp-[A-Za-z0-9][A-Za-z0-9-]{9,}|(?:sk|rk)_(?:live|test)_[A-Za-z0-9_-]{24,}|whsec_[A-Za-z0-9_-]{24,}|AIzaSy[A-Za-z0-9_-]{33,})", priority=100, base=0.95, digits=True, hints=("gh", "sk", "xox", "xapp", "rk_", "whsec", "aizasy")),
    Rule("security_token.pem", "custom:security_token", r"-----BEGIN (?:(?:RSA|EC|DSA|OPENSSH|ENCRYPTED) )?PRIVATE KEY-----\s*[A-Za-z0-9+/=]{16,}[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", priority=100, base=0.95, needs=("PRIVATE KEY",)),
)


def load_rules(path_or_text: str) -> tuple[Rule, ...]:
    """Rules of a TOML pack; unknown fields, validators and tiers, equal precedences and patterns that match a token are errors."""
    from umbra.functions.validators import RECORDABLE, VALIDATORS

    body = tomllib.loads(path_or_text) if "\n" in path_or_text or "=" in path_or_text else tomllib.load(open(path_or_text, "rb"))
    known = set(Rule.__dataclass_fields__) - {"compiled"}
    rules = []
    for raw in body.get("rules", []):
        if extra := set(raw) - known:
            raise ValueError(f"unknown rule fields {sorted(extra)}")
        rule = Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
        if rule.validator and rule.validator not in VALIDATORS:
            raise ValueError(f"unknown validator {rule.validator}")
        if rule.on_fail not in ("veto", "record") or rule.on_fail == "record" and rule.validator not in RECORDABLE:
            raise ValueError(f"{rule.id}: a failed {rule.validator} can't be recorded")
        check_shadow(rule)
        rules.append(rule)
    check_families(rules)
    return tuple(rules)


def check_shadow(rule: Rule) -> None:
    if any(compile_pattern(rule.pattern).search(t) for t in TOKEN_SAMPLES):
        raise ValueError(f"{rule.id} matches tokens of the engine itself")


def check_families(rules) -> None:
    seen: dict[tuple[str, int], str] = {}
    for r in rules:
        if r.family and seen.setdefault((r.family, r.precedence), r.variant) != r.variant:
            raise ValueError(f"{r.id}: two variants of {r.family} have precedence {r.precedence}")


def admitted(rules, chain: tuple[str, ...], opt_in: frozenset[str] = frozenset()) -> tuple[Rule, ...]:
    """Rules that run under a locale chain: format rules of the safe tier and global ones always, others if a locale
    fits; locale-gated ones need a locale of the chain by name, and opt-in ones their own id as well."""

    def fits(rule):
        return any(c == loc or c.startswith(loc + "-") for c in chain for loc in rule.locales)

    def runs(rule):
        if rule.tier == "opt_in" and rule.id not in opt_in:
            return False
        if rule.tier == "locale_gated":
            return fits(rule)
        return "global" in rule.locales or rule.basis == "format" or fits(rule)

    return tuple(r for r in rules if runs(r))


def locale_chain(cli=None, policy=None, default=None) -> tuple[str, ...]:
    """The first of the caller's, the policy's and the pack's locales that is given, and always global."""
    first = cli or policy or default or ()
    return (*(x for x in dict.fromkeys(first) if x != "global"), "global")


def model_locales(backends: dict[str, tuple[str, ...]], locale: str) -> list[str]:
    """Models for a locale: exact, else the parent language, else global; none is an error."""
    for tag in (locale, locale.split("-")[0], "global"):
        if found := sorted(name for name, locales in backends.items() if tag in locales):
            return found
    raise LookupError(f"no model covers {locale}")


def activated_classes(rules=CORE, chain: tuple[str, ...] = ("global",)) -> list[str]:
    """Distinct classes of the rules that run."""
    return sorted({r.cls for r in admitted(rules, chain)})


def uncovered_families(rules, policy: list[tuple[str, str | None, str]], chain: tuple[str, ...]) -> list[str]:
    """Family classes that fall to the policy's default by accident: a member or the family is named somewhere, but no
    rule before the default names the family. Only families with an anchored member, as those fall back regularly."""
    upto = next((i for i, r in enumerate(policy) if r[0] == "default"), len(policy))
    named = lambda part: {r[1] for r in part if r[0] == "class"}
    running = admitted(rules, chain)
    out = []
    for family in sorted({r.family for r in running if r.family and r.anchors}):
        members = {r.cls for r in running if r.family == family}
        if f"custom:family:{family}" not in named(policy[:upto]) and named(policy) & {*members, f"custom:family:{family}"}:
            out.append(f"custom:family:{family}")
    return out
