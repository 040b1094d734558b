"""License scans by ordered signature rules.

Rules are hand-written regular expressions over lower-cased text, several for each
license: grants ("licensed under the ..."), titles, SPDX lines and short names, addresses,
and whole-text phrases, besides general statements of rights. Each rule's keywords, one of
which every match holds, are read off its own pattern. One Aho-Corasick pass over all
keywords opens the gates of single rules, and only those run. Of overlapping detections a
rule of higher priority wins; one that lies inside an interval already taken (or equal to
it) is suppressed. The score is one minus the product of the remaining doubts of the kept
detections.

Besides the detections, three phrases are counted in the sequence of words, for every
text (``base``).

Defined cases: null text counts as empty; a null doc_id stays null; a text without
detections has score 0 and empty labels; texts of any length are scanned whole; repeated rows get the same result; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import functools
import re
import re._parser as sre
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, utf8

#: Phrases whose places are counted, and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Every word boundary character becomes a space, A-Z lower case.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

#: label: (pattern of the name, SPDX pattern, address pattern or "").
LICENSES = {
    "agpl-3.0": (r"(?:gnu\s+)?affero\s+general\s+public\s+licen[sc]e(?:,?\s*(?:version|v\.?)?\s*3(?:\.0)?)?", r"agpl-3\.0(?:-only|-or-later)?", r"gnu\.org/licenses/agpl"),
    "gpl-3.0": (r"(?:gnu\s+)?(?:general\s+public\s+licen[sc]e|gpl),?\s*(?:version|v\.?)?\s*3(?:\.0)?\b", r"gpl-3\.0(?:-only|-or-later)?", r"gnu\.org/licenses/gpl-3"),
    "gpl-2.0": (r"(?:gnu\s+)?(?:general\s+public\s+licen[sc]e|gpl),?\s*(?:version|v\.?)?\s*2(?:\.0)?\b", r"gpl-2\.0(?:-only|-or-later)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2"),
    "gpl": (r"(?:gnu\s+)(?:general\s+public\s+licen[sc]e|gpl)\b", r"gpl-1\.0(?:-only|-or-later)?", r"gnu\.org/(?:licenses|copyleft)/gpl\b"),
    "lgpl-3.0": (r"(?:gnu\s+)?(?:lesser\s+general\s+public\s+licen[sc]e|lgpl),?\s*(?:version|v\.?)?\s*3(?:\.0)?\b", r"lgpl-3\.0(?:-only|-or-later)?", r"gnu\.org/licenses/lgpl-3"),
    "lgpl-2.1": (r"(?:gnu\s+)?(?:lesser|library)\s+general\s+public\s+licen[sc]e,?\s*(?:version|v\.?)?\s*2(?:\.[01])?\b", r"lgpl-2\.[01](?:-only|-or-later)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2"),
    "fdl-1.3": (r"(?:gnu\s+)?free\s+documentation\s+licen[sc]e(?:,?\s*(?:version|v\.?)?\s*1\.[123])?", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu\.org/licenses/fdl"),
    "apache-2.0": (r"apache(?:\s+software)?\s+licen[sc]e,?\s*(?:version|v\.?)?\s*2(?:\.0)?\b", r"apache-2\.0", r"apache\.org/licenses/license-2\.0"),
    "apache-1.1": (r"apache(?:\s+software)?\s+licen[sc]e,?\s*(?:version|v\.?)?\s*1(?:\.[01])\b", r"apache-1\.[01]", r"apache\.org/licenses/license-1\.[01]"),
    "mit": (r"(?:the\s+)?mit(?:\s*/\s*expat|/x11)?[\s-]+licen[sc]e", r"mit", r"opensource\.org/licen[sc]es?/mit\b"),
    "x11": (r"x11\s+(?:mit\s+)?licen[sc]e", r"x11", ""),
    "isc": (r"isc\s+licen[sc]e", r"isc", r"opensource\.org/licen[sc]es?/isc"),
    "bsd-2-clause": (r"(?:simplified\s+bsd|2[\s-]+clause\s+bsd|freebsd)\s+licen[sc]e|bsd[\s-]+2[\s-]+clause(?:\s+licen[sc]e)?", r"bsd-2-clause", r"opensource\.org/licen[sc]es?/bsd-2"),
    "bsd-3-clause": (r"(?:(?:new|revised|modified)\s+bsd|3[\s-]+clause\s+bsd)\s+licen[sc]e|bsd[\s-]+3[\s-]+clause(?:\s+licen[sc]e)?", r"bsd-3-clause", r"opensource\.org/licen[sc]es?/bsd-3"),
    "bsd-4-clause": (r"(?:original\s+bsd|4[\s-]+clause\s+bsd)\s+licen[sc]e|bsd[\s-]+4[\s-]+clause(?:\s+licen[sc]e)?", r"bsd-4-clause", ""),
    "bsd": (r"bsd(?:[\s-]style)?\s+licen[sc]e", r"0bsd", r"opensource\.org/licen[sc]es?/bsd\b"),
    "mpl-2.0": (r"mozilla\s+public\s+licen[sc]e,?\s*(?:version|v\.?)?\s*2(?:\.0)?\b", r"mpl-2\.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    "mpl-1.1": (r"mozilla\s+public\s+licen[sc]e,?\s*(?:version|v\.?)?\s*1\.[01]\b", r"mpl-1\.[01]", r"mozilla\.org/mpl/1\.[01]|mozilla\.org/mpl/mpl-1"),
    "epl-2.0": (r"eclipse\s+public\s+licen[sc]e,?\s*(?:-|version|v\.?)?\s*2(?:\.0)?\b", r"epl-2\.0", r"eclipse\.org/legal/epl-2"),
    "epl-1.0": (r"eclipse\s+public\s+licen[sc]e,?\s*(?:-|version|v\.?)?\s*1(?:\.0)?\b", r"epl-1\.0", r"eclipse\.org/legal/epl-v10"),
    "cddl": (r"common\s+development\s+and\s+distribution\s+licen[sc]e", r"cddl-1\.[01]", r"opensource\.org/licen[sc]es?/cddl"),
    "cpl-1.0": (r"common\s+public\s+licen[sc]e", r"cpl-1\.0", r"opensource\.org/licen[sc]es?/cpl"),
    "eupl-1.2": (r"european\s+union\s+public\s+licen[sc]e", r"eupl-1\.[012]", r"joinup\.ec\.europa\.eu/\S*eupl"),
    "artistic-2.0": (r"artistic\s+licen[sc]e,?\s*(?:version|v\.?)?\s*2(?:\.0)?\b", r"artistic-2\.0", r"perlfoundation\.org/artistic"),
    "artistic-1.0": (r"artistic\s+licen[sc]e(?!,?\s*(?:version|v\.?)?\s*2)", r"artistic-1\.0(?:-perl|-cl8)?", ""),
    "bsl-1.0": (r"boost\s+software\s+licen[sc]e", r"bsl-1\.0", r"boost\.org/license_1_0"),
    "busl-1.1": (r"business\s+source\s+licen[sc]e", r"busl-1\.1", r"mariadb\.com/bsl11"),
    "zlib": (r"zlib(?:/libpng)?\s+licen[sc]e", r"zlib", r"opensource\.org/licen[sc]es?/zlib"),
    "libpng": (r"(?:lib)?png\s+licen[sc]e", r"libpng(?:-2\.0)?", ""),
    "python-2.0": (r"(?:python|psf)\s+(?:software\s+foundation\s+)?licen[sc]e", r"(?:python|psf)-2\.0", r"python\.org/\S*license"),
    "php-3.01": (r"php\s+licen[sc]e", r"php-3\.0?1?", r"php\.net/license"),
    "ruby": (r"ruby(?:'s)?\s+licen[sc]e", r"ruby", r"ruby-lang\.org/\S*license"),
    "openssl": (r"openssl\s+licen[sc]e", r"openssl", r"openssl\.org/source/license"),
    "ofl-1.1": (r"(?:sil\s+)?open\s+font\s+licen[sc]e", r"ofl-1\.[01](?:-rfn)?", r"scripts\.sil\.org/ofl"),
    "wtfpl": (r"do\s+what\s+the\s+f\w*\s+you\s+want\s+to\s+public\s+licen[sc]e|wtfpl", r"wtfpl", r"wtfpl\.net"),
    "unlicense": (r"(?:the\s+)?unlicen[sc]e\b", r"unlicense", r"unlicense\.org"),
    "cc0-1.0": (r"cc0(?:[\s-]+1\.0)?(?:\s+universal)?|creative\s+commons\s+zero", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    "cc-by-4.0": (r"(?:cc[\s-]by|creative\s+commons\s+attribution)(?:\s+(?:international|licen[sc]e|public))*[\s-]+4\.0", r"cc-by-4\.0", r"creativecommons\.org/licenses/by/4"),
    "cc-by-3.0": (r"(?:cc[\s-]by|creative\s+commons\s+attribution)(?:\s+(?:unported|licen[sc]e))*[\s-]+3\.0", r"cc-by-3\.0", r"creativecommons\.org/licenses/by/3"),
    "cc-by-sa-4.0": (r"(?:cc[\s-]by[\s-]sa|creative\s+commons\s+attribution[\s-]+share-?\s?alike)(?:\s+(?:international|licen[sc]e|public))*[\s-]+4\.0", r"cc-by-sa-4\.0", r"creativecommons\.org/licenses/by-sa/4"),
    "cc-by-sa-3.0": (r"(?:cc[\s-]by[\s-]sa|creative\s+commons\s+attribution[\s-]+share-?\s?alike)(?:\s+(?:unported|licen[sc]e))*[\s-]+3\.0", r"cc-by-sa-3\.0", r"creativecommons\.org/licenses/by-sa/3"),
    "cc-by-nc-4.0": (r"(?:cc[\s-]by[\s-]nc|creative\s+commons\s+attribution[\s-]+non-?\s?commercial)(?:\s+(?:international|licen[sc]e|public))*[\s-]+4\.0", r"cc-by-nc-4\.0", r"creativecommons\.org/licenses/by-nc/4"),
    "cc-by-nc-sa-4.0": (r"(?:cc[\s-]by[\s-]nc[\s-]sa|creative\s+commons\s+attribution[\s-]+non-?\s?commercial[\s-]+share-?\s?alike)(?:\s+(?:international|licen[sc]e|public))*[\s-]+4\.0", r"cc-by-nc-sa-4\.0", r"creativecommons\.org/licenses/by-nc-sa/4"),
    "cc-by-nc-nd-4.0": (r"(?:cc[\s-]by[\s-]nc[\s-]nd|creative\s+commons\s+attribution[\s-]+non-?\s?commercial[\s-]+no-?\s?deriv\w*)(?:\s+(?:international|licen[sc]e|public))*[\s-]+4\.0", r"cc-by-nc-nd-4\.0", r"creativecommons\.org/licenses/by-nc-nd/4"),
    "cc-by-nd-4.0": (r"(?:cc[\s-]by[\s-]nd|creative\s+commons\s+attribution[\s-]+no-?\s?deriv\w*)(?:\s+(?:international|licen[sc]e|public))*[\s-]+4\.0", r"cc-by-nd-4\.0", r"creativecommons\.org/licenses/by-nd/4"),
    "cc-by-nc": (r"(?:cc[\s-]by[\s-]nc\b|creative\s+commons\s+attribution[\s-]+non-?\s?commercial)", r"cc-by-nc-[123]\.[05]", r"creativecommons\.org/licenses/by-nc/[123]"),
    "cc-by-sa": (r"(?:cc[\s-]by[\s-]sa\b|creative\s+commons\s+attribution[\s-]+share-?\s?alike)", r"cc-by-sa-[12]\.[05]", r"creativecommons\.org/licenses/by-sa/[12]"),
    "cc-by": (r"(?:cc[\s-]by\b|creative\s+commons\s+attribution)", r"cc-by-[12]\.[05]", r"creativecommons\.org/licenses/by/[12]"),
    "odbl-1.0": (r"open\s+(?:data\s*commons\s+open\s+)?database\s+licen[sc]e|odbl", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    "odc-by-1.0": (r"open\s+data\s*commons\s+attribution\s+licen[sc]e", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by"),
    "pddl-1.0": (r"public\s+domain\s+dedication\s+and\s+licen[sc]e", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl"),
    "ogl-uk-3.0": (r"open\s+government\s+licen[sc]e", r"ogl-uk-[123]\.0", r"nationalarchives\.gov\.uk/doc/open-government"),
    "osl-3.0": (r"open\s+software\s+licen[sc]e", r"osl-[123]\.[01]", r"opensource\.org/licen[sc]es?/osl"),
    "afl-3.0": (r"academic\s+free\s+licen[sc]e", r"afl-[123]\.[012]", r"opensource\.org/licen[sc]es?/afl"),
    "ms-pl": (r"microsoft\s+public\s+licen[sc]e", r"ms-pl", r"opensource\.org/licen[sc]es?/ms-pl"),
    "ms-rl": (r"microsoft\s+reciprocal\s+licen[sc]e", r"ms-rl", ""),
    "ncsa": (r"(?:university\s+of\s+illinois/)?ncsa\s+(?:open\s+source\s+)?licen[sc]e", r"ncsa", ""),
    "upl-1.0": (r"universal\s+permissive\s+licen[sc]e", r"upl-1\.0", ""),
    "vim": (r"vim\s+licen[sc]e", r"vim", ""),
    "w3c": (r"w3c\s+(?:software\s+(?:notice\s+and\s+)?)?licen[sc]e", r"w3c(?:-\d+)?", r"w3\.org/consortium/legal/\S*software"),
    "lppl-1.3c": (r"latex\s+project\s+public\s+licen[sc]e|lppl", r"lppl-1\.\d[abc]?", r"latex-project\.org/lppl"),
    "qpl-1.0": (r"\bq\s+public\s+licen[sc]e", r"qpl-1\.0", ""),
    "ipl-1.0": (r"ibm\s+public\s+licen[sc]e", r"ipl-1\.0", ""),
    "apsl-2.0": (r"apple\s+public\s+source\s+licen[sc]e", r"apsl-[12]\.[012]", r"opensource\.apple\.com/apsl"),
    "sspl-1.0": (r"server\s+side\s+public\s+licen[sc]e", r"sspl-1\.0", r"mongodb\.com/licensing/server-side"),
    "elastic-2.0": (r"elastic\s+licen[sc]e", r"elastic-2\.0", r"elastic\.co/licensing/elastic-license"),
    "mulanpsl-2.0": (r"mulan\s+(?:psl|permissive\s+software\s+licen[sc]e)", r"mulanpsl-[12]\.0", r"license\.coscl\.org\.cn/mulanpsl"),
    "blueoak-1.0.0": (r"blue\s+oak\s+model\s+licen[sc]e", r"blueoak-1\.0\.0", r"blueoakcouncil\.org/license"),
    "postgresql": (r"postgresql\s+licen[sc]e", r"postgresql", r"opensource\.org/licen[sc]es?/postgresql"),
    "json": (r"json\s+licen[sc]e|shall\s+be\s+used\s+for\s+good,?\s+not\s+evil", r"json", r"json\.org/license"),
    "beerware": (r"beer-?\s?ware\s+licen[sc]e", r"beerware", ""),
    "sleepycat": (r"sleepycat\s+licen[sc]e", r"sleepycat", ""),
}

#: Whole-text phrases and statements of rights: (label, priority, doubt, pattern).
STATEMENTS = [
    ("mit", 70, 0.1, r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy"),
    ("isc", 70, 0.1, r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose"),
    ("bsd", 70, 0.15, r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms"),
    ("bsd-3-clause", 72, 0.1, r"neither\s+the\s+names?\s+of\s+[^.]{1,80}\s+nor\s+the\s+names\s+of\s+(?:its|their)\s+contributors"),
    ("gpl", 70, 0.1, r"this\s+program\s+is\s+free\s+software[:;,]?\s+you\s+can\s+redistribute\s+it\s+and/or\s+modify"),
    ("lgpl-2.1", 70, 0.1, "library is free", r"this\s+library\s+is\s+free\s+software[:;,]?\s+you\s+can\s+redistribute\s+it"),
    ("zlib", 70, 0.1, r"provided\s+'?as-is'?,?\s+without\s+any\s+express\s+or\s+implied\s+warranty"),
    ("unlicense", 70, 0.1, r"free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain"),
    ("bsl-1.0", 70, 0.1, "permission is hereby granted", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+or\s+organization"),
    ("warranty-disclaimer", 20, 0.6, r"without\s+warrant(?:y|ies)\s+(?:or\s+conditions\s+)?of\s+any\s+kind"),
    ("public-domain", 40, 0.3, r"(?:released|dedicated|placed|is)\s+(?:in(?:to)?|to)\s+the\s+public\s+domain"),
    ("all-rights-reserved", 30, 0.3, r"all\s+rights\s+reserved"),
    ("copyright-notice", 10, 0.6, r"copyright\s+(?:\(c\)|©)?\s*\d{4}(?:\s*[-,]\s*\d{4})*"),
    ("copyright-notice", 10, 0.7, r"©\s*\d{4}"),
    ("proprietary", 35, 0.3, r"proprietary\s+(?:and\s+confidential|software|licen[sc]e)"),
    ("no-redistribution", 35, 0.3, r"(?:may\s+not|must\s+not|do\s+not)\s+(?:be\s+)?redistribut\w*"),
    ("non-commercial", 35, 0.4, r"(?:for\s+)?non-?\s?commercial\s+(?:use|purposes)\s+only"),
    ("permission-required", 30, 0.4, r"without\s+(?:the\s+)?(?:prior\s+)?(?:express\s+)?(?:written\s+)?permission\s+of"),
    ("license-file", 15, 0.6, r"see\s+(?:the\s+)?(?:accompanying\s+)?licen[sc]e(?:\.txt|\.md)?\s+(?:file\s+)?for\s+(?:details|more)"),
    ("license-unknown", 5, 0.8, r"(?:released|licen[sc]ed|distributed)\s+under\s+(?:the\s+)?[\w .-]{2,40}?licen[sc]e"),
]

GRANT = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered)\s+(?:by|under)\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?"


def keywords(pattern: str) -> set[str]:
    """Strings of which every match of a pattern holds one, once runs of white space are one space.

    Read off the parsed pattern: the letters that must follow one another, a choice of few
    letters giving a string each; of several such places the one with the longest strings.
    """
    found = _required(sre.parse(pattern))
    if not found:
        raise ValueError(f"no keyword can gate {pattern}")
    return found


def _required(parsed) -> set[str]:
    best: set[str] = set()
    runs = {""}
    better = lambda a, b: max(a, b, key=lambda r: (min(map(len, r), default=0), -len(r)))
    for kind, value in parsed:
        exact = _exact(kind, value)
        if exact and len(runs) * len(exact) <= 16:
            runs = {r + e for r in runs for e in exact}
            continue
        best, runs = better(best, runs), {""}
        inner: set[str] = set()
        if kind is sre.SUBPATTERN:
            inner = _required(value[3])
        elif kind is sre.BRANCH:
            each = [_required(v) for v in value[1]]
            inner = set().union(*each) if all(each) else set()
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
            inner = _required(value[2])
        best = better(best, inner)
    best = better(best, runs)
    return best if min(map(len, best), default=0) else set()


def _exact(kind, value) -> set[str]:
    """All that one place of a pattern can be, if that is a few strings; else nothing."""
    if kind is sre.LITERAL:
        return {chr(value)}
    if kind is sre.IN and all(k is sre.LITERAL or (k, v) == (sre.CATEGORY, sre.CATEGORY_SPACE) for k, v in value):
        return {chr(v) if k is sre.LITERAL else " " for k, v in value}
    if kind is sre.MAX_REPEAT and value[0] == 1 and list(value[2]) == [(sre.IN, [(sre.CATEGORY, sre.CATEGORY_SPACE)])]:
        return {" "}
    if kind is sre.AT:
        return {""}
    if kind is sre.SUBPATTERN:
        return _sequence(value[3])
    if kind is sre.BRANCH:
        each = [_sequence(v) for v in value[1]]
        return set().union(*each) if all(each) else set()
    return set()


def _sequence(parsed) -> set[str]:
    out = {""}
    for kind, value in parsed:
        exact = _exact(kind, value)
        if not exact or len(out) * len(exact) > 16:
            return set()
        out = {a + b for a in out for b in exact}
    return out


def _spoken(spdx: str) -> str:
    """An SPDX pattern, with white space as well as hyphens between its parts."""
    return spdx.replace("-", r"[\s-]")


@functools.lru_cache(maxsize=1)
def rules():
    """All rules in order of priority: (label, priority, doubt, keywords, compiled pattern)."""
    found = []
    for label, (name, spdx, address) in LICENSES.items():
        found.append((label, 90, 0.02, rf"spdx-licen[sc]e-identifier:\s*(?:{spdx})(?![\w.-])"))
        found.append((label, 80, 0.05, rf"{GRANT}(?:{name})"))
        found.append((label, 78, 0.1, rf"{GRANT}(?:{_spoken(spdx)})(?![\w-]|\.\w)"))
        found.append((label, 77, 0.1, rf"\bunder\s+(?:the\s+)?(?:{_spoken(spdx)})\s+(?:terms|licen[sc]e)\b"))
        found.append((label, 60, 0.2, rf"(?<!\w)(?:{name})"))
        if address:
            found.append((label, 65, 0.1, rf"(?:https?://)?(?:www\.)?(?:{address})"))
    found += STATEMENTS
    order = sorted(range(len(found)), key=lambda k: (-found[k][1], k))
    return [(*found[k][:3], keywords(found[k][3]), re.compile(found[k][3])) for k in order]


@functools.lru_cache(maxsize=1)
def gates():
    """An automaton of all keywords; each opens the rules listed with it."""
    import ahocorasick

    opened: dict[str, list[int]] = {}
    for k, rule in enumerate(rules()):
        for word in rule[3]:
            opened.setdefault(word, []).append(k)
    a = ahocorasick.Automaton()
    for word, ks in opened.items():
        a.add_word(word, tuple(ks))
    a.make_automaton()
    return a


class Taken:
    """Intervals of which none holds another, to find whether one of them holds a new one."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def hold(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start) - 1
        return k >= 0 and self.ends[k] >= end

    def add(self, start: int, end: int) -> None:
        k = bisect_left(self.starts, start)
        past = max(k, bisect_right(self.ends, end))  # those from k to here lie inside the new one
        self.starts[k:past], self.ends[k:past] = [start], [end]


def detect(text: str) -> list[tuple[str, int, int, float]]:
    """Kept detections of a text: (label, start, end, doubt), by start."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only, so places stay
    spaced = " ".join(low.split())
    open_rules = {k for _, ks in gates().iter(spaced) for k in ks}
    if not open_rules:
        return []
    hits = []
    for k in sorted(open_rules):
        label, priority, doubt, _, pattern = rules()[k]
        hits += [(-priority, m.start() - m.end(), m.start(), k, m.end(), label, doubt) for m in pattern.finditer(low)]
    kept: list[tuple[int, int, str, float]] = []
    taken = Taken()
    for _, _, start, _, end, label, doubt in sorted(hits):
        if not taken.hold(start, end):
            taken.add(start, end)
            kept.append((start, end, label, doubt))
    return [(label, start, end, doubt) for start, end, label, doubt in sorted(kept)]


def base(raw: bytes) -> tuple[int, int, int | None, int | None, list[str]]:
    """Words of a text, and places of the fixed phrases: count, first, last, labels."""
    words = raw.translate(WORD_BYTES).split()
    if b"license" not in words:
        return len(words), 0, None, None, []
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        want = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(want[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(want)] == want:
                places.append(at)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: words, base places, and the kept detections with their spans."""
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("doubt", pa.float64())])
    schema = pa.schema([*fields, ("detections", pa.list_(span))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    n, places, first, last, labels = base(utf8(text))
                    found = detect(text or "")
                    doubt = 1.0
                    for d in found:
                        doubt *= d[3]
                    every = ",".join(sorted({*labels, *(d[0] for d in found)}))
                    rows.append((doc, n, places, first, last, ",".join(labels), every, 1.0 - doubt if found else 0.5 if labels else 0.0, [dict(zip(("label", "start", "end", "doubt"), d)) for d in found]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    kinds = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label: string, start: long, end: long, doubt: double>>"
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kinds)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("detections")
