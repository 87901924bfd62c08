"""The shapes of personal data and secrets that detection knows."""

from __future__ import annotations

import re

from .patterns import DIGITS, Shape, back, here, run_of, words_before


def luhn(v: str) -> bool:
    d = [int(c) for c in reversed(v) if c.isdigit()]
    return len(d) >= 12 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def iban(v: str) -> bool:
    v = re.sub(r"\s", "", v).upper()
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def ahv(v: str) -> bool:
    d = [int(c) for c in v if c.isdigit()]
    return len(d) == 13 and d[:3] == [7, 5, 6] and (10 - sum(x * (3 if i % 2 else 1) for i, x in enumerate(d[:12])) % 10) % 10 == d[12]


#: A match that fails its checksum is not reported.
RULES = [
    Shape("IBAN", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban, DIGITS, back(2)),
    Shape("AHV", r"(?<!\d)756[.\s]?\d{4}[.\s]?\d{4}[.\s]?\d{2}(?!\d)", ahv, DIGITS),
    Shape("CARD", r"(?<![\d-])(?:\d[ -]?){12,18}\d(?![\d-])", luhn, DIGITS),
    Shape("EMAIL", r"(?<![\w.+-])[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?![\w-])", None, ("@",), run_of(".+-")),
    Shape("PHONE", r"(?<![\w+])(?:\+|00)\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w+])0\d{2} \d{3} \d{2} \d{2}(?!\d)", None, DIGITS, back(1, 0)),
    Shape("IP", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.])", None, DIGITS),
    Shape("AWS_KEY", r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])", None, ("akia", "asia")),
    Shape("GITHUB_TOKEN", r"(?<!\w)gh[pousr]_[A-Za-z0-9]{36,}(?!\w)", None, tuple(f"gh{c}_" for c in "pousr")),
    Shape("JWT", r"(?<![\w-])eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}", None, ("eyj",)),
    Shape("SLACK_TOKEN", r"(?<!\w)xox[abprs]-[A-Za-z0-9-]{10,}", None, tuple(f"xox{c}-" for c in "abprs")),
    Shape("PRIVATE_KEY", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", None, ("-----begin ",)),
    Shape("MODEL_KEY", r"(?<![\w-])sk-[A-Za-z0-9_-]{20,}", None, ("sk-",)),
    Shape("ASSIGNED_SECRET", r"(?i)(?<!\w)(?:token|secret|password|api[_-]?key) ?[=:] ?[\"'][^\"'\s]{8,}[\"']", None, ("token", "secret", "password", "api_key", "api-key", "apikey")),
]

REGIONAL = [
    Shape("SG_NRIC", r"(?<!\w)[STFGM]\d{7}[A-Z](?!\w)", None, DIGITS, back(1)),
    Shape("SG_PHONE", r"(?<!\d)(?:\+65[ -]?)?[689]\d{3}[ -]?\d{4}(?!\d)", None, DIGITS, back(1, 0)),
    Shape("SG_POSTAL", r"(?i)(?<!\w)singapore \d{6}(?!\d)", None, ("singapore ",)),
    Shape("SG_PASSPORT", r"(?<!\w)[EK]\d{7}[A-Z](?!\w)", None, DIGITS, back(1)),
    Shape("EU_VAT", r"(?<!\w)(?:AT|BE|DE|DK|ES|FI|FR|IE|IT|NL|PL|PT|SE)(?=[A-Z]{0,3}\d{5})[A-Z0-9]{8,12}(?!\w)", None, DIGITS, back(5, 4, 3, 2)),
    Shape("FR_NIR", r"(?<!\d)[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}(?!\d)", None, DIGITS),
    Shape("EU_PASSPORT", r"(?<!\w)[A-Z]{1,2}\d{7}(?!\w)", None, DIGITS, back(2, 1)),
    Shape("CA_SIN", r"(?<!\d)\d{3}[ -]\d{3}[ -]\d{3}(?!\d)", None, DIGITS),
    Shape("US_SSN", r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)", None, DIGITS),
]

SUFFIXES = ("AG", "GmbH", "Inc", "Ltd", "LLC", "SA", "SE", "SARL")
ORGANIZATION = Shape("ORGANIZATION", rf"(?<!\w)(?:[A-ZÀ-Þ][\w&'-]+ ){{1,3}}(?:{'|'.join(SUFFIXES)})(?!\w)", None, tuple(f" {s.lower()}" for s in SUFFIXES), words_before(3, SUFFIXES))

# The published forms of providers' keys, as (provider, form). These begin with a prefix of their own.
PREFIXED = [
    ("adobe", r"p8e-[a-z0-9]{32}"), ("alibaba", r"LTAI[a-z0-9]{20}"), ("authress", r"(?:sc|ext|scauth|authress)_[a-z0-9]{5,30}\.[a-z0-9]{4,6}\.acc[_-][a-z0-9-]{10,32}\.[a-z0-9+/_=-]{30,120}"),
    ("clojars", r"CLOJARS_[a-z0-9]{60}"), ("databricks", r"dapi[a-h0-9]{32}"), ("digitalocean", r"do[opr]_v1_[a-f0-9]{64}"), ("doppler", r"dp\.pt\.[a-z0-9]{43}"),
    ("duffel", r"duffel_(?:test|live)_[a-z0-9_\-=]{43}"), ("dynatrace", r"dt0c01\.[a-z0-9]{24}\.[a-z0-9]{64}"), ("easypost", r"EZ[AT]K[a-z0-9]{54}"),
    ("flutterwave", r"FLW(?:PUBK|SECK)_TEST-[a-h0-9]{32}-X"), ("flutterwave", r"FLWSECK_TEST-[a-h0-9]{12}"), ("frameio", r"fio-u-[a-z0-9\-_=]{64}"), ("gcp", r"AIza[0-9A-Za-z_-]{35}"),
    ("github", r"github_pat_[0-9a-z_]{82}"), ("gitlab", r"glpat-[0-9a-z_-]{20}"), ("gitlab", r"glptt-[0-9a-f]{40}"), ("gitlab", r"GR1348941[0-9a-z_-]{20}"),
    ("grafana", r"eyJrIjoi[A-Za-z0-9]{70,400}={0,2}"), ("grafana", r"glc_[A-Za-z0-9+/]{32,400}={0,2}"), ("grafana", r"glsa_[A-Za-z0-9]{32}_[A-Fa-f0-9]{8}"),
    ("huggingface", r"hf_[a-z]{34}"), ("huggingface", r"api_org_[a-z]{34}"), ("jwt", r"ZXlK[a-z0-9/\\_+-]{40,}={0,2}"), ("linear", r"lin_api_[a-z0-9]{40}"),
    ("lob", r"(?:live|test)_[a-f0-9]{35}"), ("lob", r"(?:live|test)_pub_[a-f0-9]{31}"), ("mailgun", r"(?:pub)?key-[a-f0-9]{32}"), ("mapbox", r"pk\.[a-z0-9]{60}\.[a-z0-9]{22}"),
    ("newrelic", r"NRAK-[a-z0-9]{27}"), ("newrelic", r"NRJS-[a-f0-9]{19}"), ("npm", r"npm_[a-z0-9]{36}"), ("planetscale", r"pscale_(?:pw|tkn|oauth)_[a-z0-9=\-_.]{32,64}"),
    ("postman", r"PMAK-[a-f0-9]{24}-[a-f0-9]{34}"), ("prefect", r"pnu_[a-z0-9]{36}"), ("pulumi", r"pul-[a-f0-9]{40}"), ("pypi", r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,1000}"),
    ("readme", r"rdme_[a-z0-9]{70}"), ("rubygems", r"rubygems_[a-f0-9]{48}"), ("scalingo", r"tk-us-[a-z0-9_-]{48}"), ("sendgrid", r"SG\.[a-z0-9=_\-.]{66}"),
    ("sendinblue", r"xkeysib-[a-f0-9]{64}-[a-z0-9]{16}"), ("shippo", r"shippo_(?:live|test)_[a-f0-9]{40}"), ("shopify", r"shp(?:at|ca|pa|ss)_[a-f0-9]{32}"),
    ("slack", r"xapp-\d-[A-Z0-9]+-\d+-[a-z0-9]+"), ("slack", r"xoxe\.xox[bp]-\d-[A-Z0-9]{163,166}"), ("slack", r"xoxe-\d-[A-Z0-9]{146}"), ("slack", r"xox[os]-\d+-\d+-\d+-[a-f\d]+"),
    ("slack", r"hooks\.slack\.com/(?:services|workflows)/[A-Za-z0-9+/]{43,46}"), ("square", r"sq0atp-[a-z0-9_-]{22}"), ("stripe", r"[rs]k_(?:live|test)_[a-z0-9]{24,}"),
    ("twilio", r"SK[a-f0-9]{32}"), ("typeform", r"tfp_[a-z0-9\-_.=]{59}"), ("vault", r"hvb\.[a-z0-9_-]{138,212}"), ("vault", r"hvs\.[a-z0-9_-]{90,100}"),
    ("yandex", r"t1\.[a-z0-9_-]+={0,2}\.[a-z0-9_-]{86}={0,2}"), ("yandex", r"AQVN[a-z0-9_-]{35,38}"),
]

_UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"

# Fixed values as well: forms that tell a secret only where the provider's name stands before it, as (names, forms).
ASSIGNED = [
    ("adafruit", r"[a-z0-9_-]{32}"), ("adobe", r"[a-f0-9]{32}"), ("airtable", r"[a-z0-9]{17}"), ("algolia", r"[a-z0-9]{32}"), ("alibaba", r"[a-z0-9]{30}"), ("asana", r"[0-9]{16}|[a-z0-9]{32}"),
    ("atlassian|confluence|jira", r"[a-z0-9]{24}"), ("beamer", r"b_[a-z0-9=_\-]{44}"), ("bitbucket", r"[a-z0-9]{32}|[a-z0-9=_\-]{64}"), ("bittrex", r"[a-z0-9]{32}"),
    ("codecov", r"[a-z0-9]{32}"), ("coinbase", r"[a-z0-9_-]{64}"), ("confluent", r"[a-z0-9]{16}|[a-z0-9]{64}"), ("contentful", r"[a-z0-9=_\-]{43}"), ("datadog", r"[a-z0-9]{40}"),
    ("dnkey", r"dnkey-[a-z0-9=_\-]{26}-[a-z0-9=_\-]{52}"), ("discord", r"[a-f0-9]{64}|[0-9]{18}|[a-z0-9=_\-]{32}"), ("droneci", r"[a-z0-9]{32}"),
    ("dropbox", r"[a-z0-9]{15}|[a-z0-9]{11}AAAAAAAAAA[a-z0-9\-_=]{43}|sl\.[a-z0-9\-=_]{135}"), ("etsy", r"[a-z0-9]{24}"), ("facebook", r"[a-f0-9]{32}"), ("fastly", r"[a-z0-9=_\-]{32}"),
    ("finicity", r"[a-f0-9]{32}|[a-z0-9]{20}"), ("finnhub", r"[a-z0-9]{20}"), ("flickr", r"[a-z0-9]{32}"), ("freshbooks", r"[a-z0-9]{64}"), ("gitter", r"[a-z0-9_-]{40}"),
    ("gocardless", r"live_[a-z0-9\-_=]{40}"), ("heroku", _UUID), ("hubspot", _UUID), ("intercom", r"[a-z0-9=_\-]{60}"), ("jfrog|artifactory|bintray|xray", r"[a-z0-9]{73}|[a-z0-9]{64}"),
    ("kraken", r"[a-z0-9/=_+\-]{80,90}"), ("kucoin", rf"[a-f0-9]{{24}}|{_UUID}"), ("launchdarkly", r"[a-z0-9=_\-]{40}"), ("linear", r"[a-f0-9]{32}"), ("linkedin|linked-in", r"[a-z0-9]{14}|[a-z0-9]{16}"),
    ("mailgun", r"[a-h0-9]{32}-[a-h0-9]{8}-[a-h0-9]{8}"), ("mattermost", r"[a-z0-9]{26}"), ("messagebird|message-bird|message_bird", rf"[a-z0-9]{{25}}|{_UUID}"), ("netlify", r"[a-z0-9=_\-]{40,46}"),
    ("new-relic|newrelic|new_relic", r"[a-z0-9]{64}"), ("nytimes|new-york-times|newyorktimes", r"[a-z0-9=_\-]{32}"), ("okta", r"[a-z0-9=_\-]{42}"), ("rapidapi", r"[a-z0-9_-]{50}"),
    ("sendbird", rf"{_UUID}|[a-f0-9]{{40}}"), ("sentry", r"[a-f0-9]{64}"), ("snyk", _UUID), ("squarespace", _UUID), ("sumo", r"su[a-z0-9]{12}|[a-z0-9]{64}"), ("travis", r"[a-z0-9]{22}"), ("twitch", r"[a-z0-9]{30}"),
    ("twitter", r"[a-z0-9]{45}|[0-9]{15,25}-[a-z0-9]{20,40}|[a-z0-9]{25}|[a-z0-9]{50}|A{22}[a-z0-9%]{80,100}"), ("yandex", r"YC[a-z0-9_\-]{38}"),
]


def _expanded(pattern: str) -> tuple[str, ...]:
    """The literals, in lower case, with which a match of a prefixed form begins: its leading characters, choices spelt out."""
    heads, i = [""], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and pattern[i + 1] in ".-/":
            heads, i = [h + pattern[i + 1] for h in heads], i + 2
            continue
        close = {"[": "]", "(": ")"}.get(c)
        end = pattern.index(close, i) if close else i
        after = pattern[end + 1 : end + 2]
        if c == "[" and "-" not in pattern[i:end] and after not in ("{", "+", "*", "?"):
            heads = [h + x for h in heads for x in pattern[i + 1 : end]]
        elif c == "(" and pattern.startswith("(?:", i) and "[" not in pattern[i:end]:
            heads = [h + x for h in heads for x in [*pattern[i + 3 : end].split("|"), *([""] if after == "?" else [])]]
            end += after == "?"
        elif c not in "\\[(" and after not in ("{", "?"):
            heads = [h + c for h in heads]
        else:
            break
        i = end + 1
    return tuple(sorted({h.lower() for h in heads}))


def _assigned(names: str, forms: str) -> Shape:
    """A form after one of the provider's names and a sign of assignment; the value alone is reported."""
    named = rf"(?i)(?:{names})[\w\-\t .]{{0,20}}[\s'\"|]{{0,3}}(?:=>|<=|\|\|:|:{{1,3}}=|\?=|=|>|:)['\"\s=`]{{0,5}}({forms})(?=['\"\s`;|]|$)"
    return Shape(names.split("|")[0], named, None, tuple(names.split("|")), here)


SECRETS = [
    *(Shape(name, rf"(?i)(?<![\w-]){form}(?![\w-])", None, _expanded(form)) for name, form in PREFIXED),
    Shape("hashicorp", r"(?i)(?<![\w-])[a-z0-9]{14}\.atlasv1\.[a-z0-9\-_=]{60,70}(?![\w-])", None, (".atlasv1.",), back(14)),
    Shape("telegram", r"(?i)(?<![0-9])[0-9]{5,16}:A[a-z0-9_\-]{34}(?![\w-])", None, DIGITS),
    Shape("teams", r"(?i)https://[a-z0-9]+\.webhook\.office\.com/webhookb2/[a-z0-9-]{36}@[a-z0-9-]{36}/IncomingWebhook/[a-z0-9]{32}/[a-z0-9-]{36}", None, ("https://",)),
    *(_assigned(names, forms) for names, forms in ASSIGNED),
]
