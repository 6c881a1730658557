"""License scans: ordered signature rules behind a keyword gate, with suppression of overlapped detections.

Everything is one pass of column expressions over each whole text; nothing is shuffled. The gate lists
the keywords a text holds, only rules of those keywords run, and only on texts that hold any.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, and what words are made of, as the contents of a character class.
BREAKS = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"
#: Phrases that are counted word by word, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, gate keywords (one for each way to begin, parted by |), and the pattern of a license's name.
NAMES = [
    ("mit", "mit|expat|x11", r"(?:mit|expat|x11)(?:[\s/-]x11)?"),
    ("mit-0", "mit", r"mit[\s-]+(?:no[\s-]attribution|0)"),
    ("apache-1.0", "apache", r"apache(?:\s+software)?(?:\s+license)?,?\s*(?:v|version)?\s*1\.0"),
    ("apache-1.1", "apache", r"apache(?:\s+software)?(?:\s+license)?,?\s*(?:v|version)?\s*1\.1"),
    ("apache-2.0", "apache", r"apache(?:\s+software)?(?:[\s-]+license)?,?[\s-]*(?:v|version)?\s*2(?:\.0)?"),
    ("gpl-1.0", "general public", r"(?:gnu\s+)?general\s+public\s+licen[sc]e,?\s*(?:v|version)?\s*1(?:\.0)?"),
    ("gpl-2.0", "general public", r"(?:gnu\s+)?general\s+public\s+licen[sc]e,?\s*(?:v|version)?\s*2(?:\.0)?"),
    ("gpl-3.0", "general public", r"(?:gnu\s+)?general\s+public\s+licen[sc]e,?\s*(?:v|version)?\s*3(?:\.0)?"),
    ("gpl-2.0", "gpl", r"(?:gnu\s+)?gpl[\s-]*(?:v|version)?\s*2(?:\.0)?(?:[\s-]only)?"),
    ("gpl-3.0", "gpl", r"(?:gnu\s+)?gpl[\s-]*(?:v|version)?\s*3(?:\.0)?(?:[\s-]only)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu\s+)?lgpl[\s-]*(?:v|version)?\s*2\.1"),
    ("lgpl-3.0", "lgpl", r"(?:gnu\s+)?lgpl[\s-]*(?:v|version)?\s*3(?:\.0)?"),
    ("lgpl-2.1", "lesser general", r"(?:gnu\s+)?lesser\s+general\s+public\s+license,?\s*(?:v|version)?\s*2\.1"),
    ("lgpl-3.0", "lesser general", r"(?:gnu\s+)?lesser\s+general\s+public\s+license,?\s*(?:v|version)?\s*3(?:\.0)?"),
    ("agpl-3.0", "affero", r"(?:gnu\s+)?affero\s+general\s+public\s+license,?\s*(?:v|version)?\s*3(?:\.0)?"),
    ("agpl-3.0", "agpl", r"(?:gnu\s+)?agpl[\s-]*(?:v|version)?\s*3(?:\.0)?"),
    ("bsd-2-clause", "bsd", r"(?:simplified\s+bsd|bsd[\s-]+2[\s-]+clause|(?:2|two)[\s-]+clause\s+bsd)"),
    ("bsd-3-clause", "bsd", r"(?:(?:new|modified|revised)\s+bsd|bsd[\s-]+3[\s-]+clause|(?:3|three)[\s-]+clause\s+bsd)"),
    ("bsd-4-clause", "bsd", r"(?:original\s+bsd|bsd[\s-]+4[\s-]+clause|(?:4|four)[\s-]+clause\s+bsd)"),
    ("0bsd", "0bsd|zero", r"(?:0bsd|zero[\s-]+clause\s+bsd)"),
    ("cc-by-4.0", "cc", r"cc[\s-]+by[\s-]+4\.0"),
    ("cc-by-3.0", "cc", r"cc[\s-]+by[\s-]+3\.0"),
    ("cc-by-sa-4.0", "cc", r"cc[\s-]+by-sa[\s-]+4\.0"),
    ("cc-by-sa-3.0", "cc", r"cc[\s-]+by-sa[\s-]+3\.0"),
    ("cc-by-nc-4.0", "cc", r"cc[\s-]+by-nc[\s-]+4\.0"),
    ("cc-by-nd-4.0", "cc", r"cc[\s-]+by-nd[\s-]+4\.0"),
    ("cc-by-nc-sa-4.0", "cc", r"cc[\s-]+by-nc-sa[\s-]+4\.0"),
    ("cc-by-nc-nd-4.0", "cc", r"cc[\s-]+by-nc-nd[\s-]+4\.0"),
    ("cc0-1.0", "cc", r"cc0(?:[\s-]+1\.0)?(?:\s+universal)?"),
    ("cc-by-4.0", "creative commons", r"creative\s+commons\s+attribution\s+4\.0(?:\s+international)?"),
    ("cc-by-sa-4.0", "creative commons", r"creative\s+commons\s+attribution[\s-]+share-?alike\s+4\.0(?:\s+international)?"),
    ("cc-by-nc-4.0", "creative commons", r"creative\s+commons\s+attribution[\s-]+non-?commercial\s+4\.0(?:\s+international)?"),
    ("cc0-1.0", "creative commons", r"creative\s+commons\s+zero"),
    ("mpl-1.1", "mozilla", r"mozilla\s+public\s+license,?\s*(?:v|version)?\s*1\.1"),
    ("mpl-2.0", "mozilla", r"mozilla\s+public\s+license,?\s*(?:v|version)?\s*2(?:\.0)?"),
    ("epl-1.0", "eclipse", r"eclipse\s+public\s+license(?:\s*-)?,?\s*(?:v|version)?\s*1\.0"),
    ("epl-2.0", "eclipse", r"eclipse\s+public\s+license(?:\s*-)?,?\s*(?:v|version)?\s*2\.0"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?:/libpng)?"),
    ("bsl-1.0", "boost", r"boost\s+software\s+license(?:,?\s*(?:v|version)?\s*1\.0)?"),
    ("artistic-2.0", "artistic", r"artistic\s+license,?\s*(?:v|version)?\s*2\.0"),
    ("eupl-1.2", "european union public", r"european\s+union\s+public\s+licen[cs]e,?\s*(?:v|version)?\s*1\.2"),
    ("ofl-1.1", "sil open font", r"sil\s+open\s+font\s+license(?:,?\s*(?:v|version)?\s*1\.1)?"),
    ("unlicense", "unlicense", r"(?:the\s+)?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("ms-pl", "microsoft public", r"microsoft\s+public\s+license"),
    ("cddl-1.0", "common development", r"common\s+development\s+and\s+distribution\s+license(?:,?\s*(?:v|version)?\s*1\.0)?"),
    ("odbl-1.0", "open database", r"open\s+database\s+license"),
    ("python-2.0", "python software", r"python\s+software\s+foundation\s+license"),
]
#: How notices are worded around a name ({n}), with rank (larger wins) and confidence.
FORMS = [
    (r"spdx-license-identifier:\s*{n}", 100, 1.0),
    (r"(?:licen[sc]ed|released|distributed|available|provided|published|shared)\s+(?:to\s+you\s+)?under\s+(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+)?(?:the\s+)?{n}(?:\s+licen[sc]e)?", 90, 0.95),
    (r"(?:subject\s+to|governed\s+by|covered\s+by|use\s+of\s+this\s+\w+\s+is\s+under)\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?{n}(?:\s+licen[sc]e)?", 85, 0.9),
    (r"licen[sc]e\s*[:=]\s*[\"']?{n}", 80, 0.9),
    (r"(?:the\s+)?{n}\s+licen[sc]e", 60, 0.75),
]
#: Notices without a license's name.
OTHERS = [
    ("gpl", "general public", r"(?:gnu\s+)?general\s+public\s+licen[sc]e", 40, 0.6),
    ("lgpl", "lesser general", r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[sc]e", 45, 0.6),
    ("agpl", "affero", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[sc]e", 45, 0.6),
    ("apache", "apache", r"apache(?:\s+software)?\s+licen[sc]e", 40, 0.6),
    ("creative-commons", "creative commons", r"creative\s+commons\s+licen[sc]e", 40, 0.6),
    ("mit", "permission is hereby", r"permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge,?\s+to\s+any\s+person\s+obtaining\s+a\s+copy", 70, 0.9),
    ("isc", "permission to use", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software", 70, 0.85),
    ("bsd", "redistribution", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms", 70, 0.85),
    ("public-domain", "public domain", r"(?:dedicated\s+to|released\s+into|in)\s+the\s+public\s+domain", 50, 0.7),
    ("all-rights-reserved", "all rights reserved", r"all\s+rights\s+reserved", 20, 0.4),
]


#: Sentences of license texts and notices, as label, gate keywords, pattern, rank and confidence.
SENTENCES = [
    # grants with a version, "or later" and "only"
    ("gpl-1.0-or-later", "general public", r"general\s+public\s+license\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation[;,]\s+either\s+version\s+1,?\s+or\s+\(at\s+your\s+option\)\s+any\s+later\s+version", 97, 0.98),
    ("gpl-2.0-or-later", "general public", r"general\s+public\s+license\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation[;,]\s+either\s+version\s+2(?:\s+of\s+the\s+license)?,?\s+or\s+\(at\s+your\s+option\)\s+any\s+later\s+version", 97, 0.98),
    ("gpl-3.0-or-later", "general public", r"general\s+public\s+license\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation[;,]\s+either\s+version\s+3(?:\s+of\s+the\s+license)?,?\s+or\s+\(at\s+your\s+option\)\s+any\s+later\s+version", 97, 0.98),
    ("lgpl-2.0-or-later", "library general", r"library\s+general\s+public\s+license\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation[;,]\s+either\s+version\s+2(?:\s+of\s+the\s+license)?,?\s+or\s+\(at\s+your\s+option\)\s+any\s+later\s+version", 98, 0.98),
    ("lgpl-2.1-or-later", "lesser general", r"lesser\s+general\s+public\s+license\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation[;,]\s+either\s+version\s+2\.1(?:\s+of\s+the\s+license)?,?\s+or\s+\(at\s+your\s+option\)\s+any\s+later\s+version", 98, 0.98),
    ("lgpl-3.0-or-later", "lesser general", r"lesser\s+general\s+public\s+license\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation[;,]\s+either\s+version\s+3(?:\s+of\s+the\s+license)?,?\s+or\s+\(at\s+your\s+option\)\s+any\s+later\s+version", 98, 0.98),
    ("agpl-3.0-or-later", "affero", r"affero\s+general\s+public\s+license\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation[;,]\s+either\s+version\s+3(?:\s+of\s+the\s+license)?,?\s+or\s+\(at\s+your\s+option\)\s+any\s+later\s+version", 98, 0.98),
    ("gpl-2.0-only", "general public", r"general\s+public\s+license,?\s+version\s+2,?\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation", 96, 0.97),
    ("gpl-3.0-only", "general public", r"general\s+public\s+license,?\s+version\s+3,?\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation", 96, 0.97),
    ("lgpl-2.1-only", "lesser general", r"lesser\s+general\s+public\s+license,?\s+version\s+2\.1,?\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation", 96, 0.97),
    ("agpl-3.0-only", "affero", r"affero\s+general\s+public\s+license,?\s+version\s+3,?\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation", 96, 0.97),
    ("gpl-2.0-or-later", "general public", r"general\s+public\s+licen[sc]e\s+(?:v|version\s+)2\s+or\s+(?:any\s+)?later", 95, 0.95),
    ("gpl-3.0-or-later", "general public", r"general\s+public\s+licen[sc]e\s+(?:v|version\s+)3\s+or\s+(?:any\s+)?later", 95, 0.95),
    ("gpl-2.0-or-later", "spdx", r"spdx-license-identifier:\s*gpl-2\.0(?:\+|-or-later)", 101, 1.0),
    ("gpl-3.0-or-later", "spdx", r"spdx-license-identifier:\s*gpl-3\.0(?:\+|-or-later)", 101, 1.0),
    ("lgpl-2.1-or-later", "spdx", r"spdx-license-identifier:\s*lgpl-2\.1(?:\+|-or-later)", 101, 1.0),
    ("lgpl-3.0-or-later", "spdx", r"spdx-license-identifier:\s*lgpl-3\.0(?:\+|-or-later)", 101, 1.0),
    ("agpl-3.0-or-later", "spdx", r"spdx-license-identifier:\s*agpl-3\.0(?:\+|-or-later)", 101, 1.0),
    ("apache-2.0 with llvm-exception", "spdx", r"spdx-license-identifier:\s*apache-2\.0\s+with\s+llvm-exception", 102, 1.0),
    ("gpl-2.0 with linux-syscall-note", "spdx", r"spdx-license-identifier:\s*gpl-2\.0\s+with\s+linux-syscall-note", 102, 1.0),
    ("gpl-2.0 with classpath-exception", "spdx", r"spdx-license-identifier:\s*gpl-2\.0(?:-only)?\s+with\s+classpath-exception-2\.0", 102, 1.0),
    ("mit or apache-2.0", "spdx", r"spdx-license-identifier:\s*mit\s+or\s+apache-2\.0", 102, 1.0),
    ("mit or apache-2.0", "spdx", r"spdx-license-identifier:\s*apache-2\.0\s+or\s+mit", 102, 1.0),
    # exceptions and additional permissions
    ("classpath-exception", "permission to link", r"permission\s+to\s+link\s+this\s+library\s+with\s+independent\s+modules\s+to\s+produce\s+an\s+executable", 94, 0.95),
    ("gcc-exception", "additional permissions", r"additional\s+permissions\s+described\s+in\s+the\s+gcc\s+runtime\s+library\s+exception", 94, 0.95),
    ("bison-exception", "special exception", r"special\s+exception,\s+you\s+may\s+create\s+a\s+larger\s+work\s+that\s+contains\s+part\s+or\s+all\s+of\s+the\s+bison\s+parser\s+skeleton\s+and\s+distribute\s+that\s+work\s+under\s+terms\s+of\s+your\s+choice", 94, 0.95),
    ("openssl-exception", "permission to link", r"permission\s+to\s+link\s+(?:the\s+code\s+of\s+portions\s+of\s+)?this\s+program\s+with\s+the\s+openssl\s+library", 94, 0.95),
    ("font-exception", "embed this font", r"embed\s+this\s+font\s+or\s+unaltered\s+portions\s+of\s+this\s+font\s+into\s+the\s+document,\s+this\s+font\s+does\s+not\s+by\s+itself\s+cause\s+the\s+resulting\s+document\s+to\s+be\s+covered", 94, 0.95),
    ("linking-exception", "linking this library", r"linking\s+this\s+library\s+statically\s+or\s+dynamically\s+with\s+other\s+modules\s+is\s+making\s+a\s+combined\s+work\s+based\s+on\s+this\s+library\s+and\s+is\s+covered", 94, 0.9),
    # MIT and its kin
    ("mit", "subject to the", r"subject\s+to\s+the\s+following\s+conditions:\s+the\s+above\s+copyright\s+notice\s+and\s+this\s+permission\s+notice\s+shall\s+be\s+included", 72, 0.92),
    ("mit", "rights to use", r"rights\s+to\s+use,\s+copy,\s+modify,\s+merge,\s+publish,\s+distribute,\s+sublicense,\s+and/or\s+sell\s+copies", 72, 0.92),
    ("mit", "above copyright notice", r"above\s+copyright\s+notice\s+and\s+this\s+permission\s+notice\s+shall\s+be\s+included\s+in\s+all\s+copies", 71, 0.9),
    ("mit", "distributed under", r"distributed\s+under\s+the\s+(?:terms\s+of\s+the\s+)?expat\s+license", 91, 0.95),
    ("mit", "free software", r"free\s+software\s+available\s+under\s+the\s+mit\s+license", 91, 0.95),
    ("isc", "permission to use", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and/or\s+distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee\s+is\s+hereby\s+granted,\s+provided", 74, 0.93),
    ("0bsd", "permission to use", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and/or\s+distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee\s+is\s+hereby\s+granted\.", 74, 0.9),
    ("hpnd", "permission to use", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and\s+distribute\s+this\s+software\s+and\s+its\s+documentation\s+for\s+any\s+purpose", 74, 0.88),
    ("mit", "sell copies", r"sell\s+copies\s+of\s+the\s+software,\s+and\s+to\s+permit\s+persons\s+to\s+whom\s+the\s+software\s+is\s+furnished\s+to\s+do\s+so,\s+subject", 72, 0.85),
    ("ntp", "permission to use", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and\s+distribute\s+this\s+software\s+and\s+its\s+documentation\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee", 75, 0.9),
    ("postgresql", "permission to use", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and\s+distribute\s+this\s+software\s+and\s+its\s+documentation\s+for\s+any\s+purpose,\s+without\s+fee,\s+and\s+without\s+a\s+written\s+agreement", 76, 0.95),
    # BSD
    ("bsd", "redistributions", r"redistributions\s+of\s+source\s+code\s+must\s+retain\s+the\s+above\s+copyright\s+notice", 70, 0.9),
    ("bsd", "redistributions", r"redistributions\s+in\s+binary\s+form\s+must\s+reproduce\s+the\s+above\s+copyright\s+notice", 70, 0.9),
    ("bsd-3-clause", "neither the name", r"neither\s+the\s+name\s+of\s+the\s+copyright\s+holder\s+nor\s+the\s+names\s+of\s+its\s+contributors\s+may\s+be\s+used\s+to\s+endorse\s+or\s+promote\s+products\s+derived\s+from\s+this\s+software\s+without\s+specific\s+prior\s+written\s+permission", 74, 0.95),
    ("bsd-3-clause", "endorse or promote", r"endorse\s+or\s+promote\s+products\s+derived\s+from\s+this\s+software\s+without\s+specific\s+prior\s+written\s+permission", 73, 0.93),
    ("bsd-4-clause", "advertising materials", r"advertising\s+materials\s+mentioning\s+features\s+or\s+use\s+of\s+this\s+software\s+must\s+display\s+the\s+following\s+acknowledge?ment", 73, 0.9),
    ("bsd-3-clause-clear", "express or implied", r"express\s+or\s+implied\s+licenses\s+to\s+any\s+party's\s+patent\s+rights\s+are\s+granted\s+by\s+this\s+license", 74, 0.93),
    ("bsd", "bsd-style", r"bsd-style\s+licen[sc]e\s+that\s+can\s+be\s+found\s+in\s+the\s+license\s+file", 88, 0.9),
    ("bsd", "bsd style", r"bsd\s+style\s+licen[sc]e", 60, 0.7),
    ("bsd-2-clause-patent", "bsd", r"bsd\s*\+\s*patent\s+licen[sc]e", 75, 0.9),
    # Apache
    ("apache-2.0", "apache license", r"apache\s+license,?\s+version\s+2\.0\s+\(the\s+license\);\s+you\s+may\s+not\s+use\s+this\s+file\s+except\s+in\s+compliance", 92, 0.98),
    ("apache-2.0", "obtain a copy", r"obtain\s+a\s+copy\s+of\s+the\s+license\s+at\s+https?://www\.apache\.org/licenses/license-2\.0", 92, 0.98),
    ("apache-2.0", "required by applicable", r"required\s+by\s+applicable\s+law\s+or\s+agreed\s+to\s+in\s+writing,\s+software\s+distributed\s+under\s+the\s+license\s+is\s+distributed\s+on\s+an\s+as\s+is\s+basis", 80, 0.9),
    ("apache-2.0", "grant of patent", r"grant\s+of\s+patent\s+license\.\s+subject\s+to\s+the\s+terms\s+and\s+conditions\s+of\s+this\s+license", 78, 0.92),
    ("apache-2.0", "grant of copyright", r"grant\s+of\s+copyright\s+license\.\s+subject\s+to\s+the\s+terms\s+and\s+conditions\s+of\s+this\s+license", 78, 0.92),
    ("apache-2.0", "contributor license", r"contributor\s+license\s+agreements\.\s+see\s+the\s+notice\s+file\s+distributed\s+with\s+this\s+work", 78, 0.85),
    ("apache-1.1", "acknowledgment", r"acknowledgment:?\s+this\s+product\s+includes\s+software\s+developed\s+by\s+the\s+apache\s+software\s+foundation", 78, 0.88),
    ("apache-2.0", "asl", r"asl\s+2\.0\s+licen[sc]e", 75, 0.85),
    # GNU texts
    ("gpl", "gpl", r"gnu\s+gpl\s+licen[sc]e", 55, 0.75),
    ("gpl", "free software", r"free\s+software;\s+you\s+can\s+redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms\s+of\s+the\s+gnu\s+general\s+public\s+license", 82, 0.92),
    ("lgpl", "free software", r"free\s+software;\s+you\s+can\s+redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms\s+of\s+the\s+gnu\s+(?:lesser|library)\s+general\s+public\s+license", 83, 0.92),
    ("agpl", "free software", r"free\s+software:\s+you\s+can\s+redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms\s+of\s+the\s+gnu\s+affero\s+general\s+public\s+license", 83, 0.92),
    ("gpl", "you should have", r"you\s+should\s+have\s+received\s+a\s+copy\s+of\s+the\s+gnu\s+general\s+public\s+license\s+along\s+with\s+this\s+program", 79, 0.9),
    ("lgpl", "you should have", r"you\s+should\s+have\s+received\s+a\s+copy\s+of\s+the\s+gnu\s+lesser\s+general\s+public\s+license\s+along\s+with\s+this\s+library", 79, 0.9),
    ("agpl", "you should have", r"you\s+should\s+have\s+received\s+a\s+copy\s+of\s+the\s+gnu\s+affero\s+general\s+public\s+license\s+along\s+with\s+this\s+program", 79, 0.9),
    ("gpl", "licenses for most", r"licenses\s+for\s+most\s+software\s+(?:and\s+other\s+practical\s+works\s+)?are\s+designed\s+to\s+take\s+away\s+your\s+freedom", 77, 0.93),
    ("gfdl-1.1", "free documentation", r"free\s+documentation\s+license,?\s+version\s+1\.1", 76, 0.9),
    ("gfdl-1.2", "free documentation", r"free\s+documentation\s+license,?\s+version\s+1\.2", 76, 0.9),
    ("gfdl-1.3", "free documentation", r"free\s+documentation\s+license,?\s+version\s+1\.3", 76, 0.9),
    ("gfdl", "free documentation", r"free\s+documentation\s+license", 50, 0.75),
    ("lgpl", "lgpl", r"lgpl\s+licen[sc]ed?", 52, 0.7),
    ("agpl", "agpl", r"agpl\s+licen[sc]ed?", 52, 0.7),
    ("gpl", "gpl", r"gpl\s+licen[sc]ed?", 52, 0.7),
    # Mozilla, Eclipse, CDDL and other weak copyleft
    ("mpl-2.0", "source code form", r"source\s+code\s+form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla\s+public\s+license,\s+v\.\s+2\.0", 93, 0.98),
    ("mpl-1.1", "contents of this", r"contents\s+of\s+this\s+file\s+are\s+subject\s+to\s+the\s+mozilla\s+public\s+license\s+version\s+1\.1", 93, 0.97),
    ("mpl-1.0", "contents of this", r"contents\s+of\s+this\s+file\s+are\s+subject\s+to\s+the\s+mozilla\s+public\s+license\s+version\s+1\.0", 93, 0.97),
    ("npl-1.1", "contents of this", r"contents\s+of\s+this\s+file\s+are\s+subject\s+to\s+the\s+netscape\s+public\s+license", 92, 0.95),
    ("cddl-1.0", "contents of this", r"contents\s+of\s+this\s+file\s+are\s+subject\s+to\s+the\s+terms\s+of\s+the\s+common\s+development\s+and\s+distribution\s+license", 92, 0.95),
    ("mpl-2.0", "incompatible with", r"incompatible\s+with\s+secondary\s+licenses,\s+as\s+defined\s+by\s+the\s+mozilla\s+public\s+license", 90, 0.9),
    ("epl-1.0", "accompanying materials", r"accompanying\s+materials\s+are\s+made\s+available\s+under\s+the\s+terms\s+of\s+the\s+eclipse\s+public\s+license\s+v1\.0", 93, 0.97),
    ("epl-2.0", "accompanying materials", r"accompanying\s+materials\s+are\s+made\s+available\s+under\s+the\s+terms\s+of\s+the\s+eclipse\s+public\s+license\s+(?:v\.\s+)?2\.0", 93, 0.97),
    ("edl-1.0", "eclipse distribution", r"eclipse\s+distribution\s+license,?\s+(?:v|version)\s*1\.0", 76, 0.9),
    ("cpl-1.0", "common public", r"common\s+public\s+license,?\s+(?:v|version)\s*1\.0", 76, 0.9),
    ("ipl-1.0", "ibm public", r"ibm\s+public\s+license,?\s+(?:v|version)\s*1\.0", 76, 0.9),
    ("osl-3.0", "open software", r"open\s+software\s+license,?\s+(?:v|version)\s*\.?\s*3\.0", 76, 0.9),
    ("afl-3.0", "academic free", r"academic\s+free\s+license,?\s+(?:v|version)\s*\.?\s*3\.0", 76, 0.9),
    ("apsl-2.0", "apple public", r"apple\s+public\s+source\s+license,?\s+(?:v|version)\s*2\.0", 76, 0.9),
    ("qpl-1.0", "q public", r"q\s+public\s+license,?\s+version\s+1\.0", 76, 0.9),
    ("eupl-1.1", "european union public", r"european\s+union\s+public\s+licen[cs]e,?\s+(?:v|version)\s*\.?\s*1\.1", 76, 0.9),
    ("cecill-2.1", "cecill", r"cecill\s+(?:free\s+software\s+)?license\s+(?:agreement\s+)?version\s+2\.1", 76, 0.9),
    ("ms-rl", "microsoft reciprocal", r"microsoft\s+reciprocal\s+license", 76, 0.9),
    ("ms-pl", "ms-pl", r"ms-pl\s+licen[sc]e", 62, 0.8),
    ("ecl-2.0", "educational community", r"educational\s+community\s+license,?\s+version\s+2\.0", 76, 0.9),
    ("upl-1.0", "universal permissive", r"universal\s+permissive\s+license,?\s+(?:v|version)\s*1\.0", 76, 0.9),
    ("ncsa", "university of illinois", r"university\s+of\s+illinois/ncsa\s+open\s+source\s+license", 76, 0.92),
    ("vim", "vim license", r"vim\s+license", 55, 0.75),
    ("ruby", "ruby license", r"ruby\s+license", 55, 0.75),
    ("php-3.01", "php license", r"php\s+license,?\s+version\s+3\.01", 76, 0.92),
    ("php-3.0", "php license", r"php\s+license,?\s+version\s+3\.0", 76, 0.9),
    ("zope-2.1", "zope public", r"zope\s+public\s+license\s+\(zpl\)\s+version\s+2\.1", 76, 0.92),
    ("openssl", "openssl license", r"openssl\s+license", 60, 0.8),
    ("artistic-1.0", "artistic license", r"artistic\s+license\s+1\.0", 76, 0.9),
    ("artistic", "under the same", r"under\s+the\s+same\s+terms\s+as\s+perl\s+itself", 76, 0.88),
    ("bsl-1.0", "boost software", r"boost\s+software\s+license\s+-\s+version\s+1\.0\s+-\s+august\s+17th,?\s+2003", 93, 0.97),
    ("bsl-1.0", "permission is hereby", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+or\s+organization\s+obtaining\s+a\s+copy\s+of\s+the\s+software", 76, 0.93),
    ("zlib", "permission is granted", r"permission\s+is\s+granted\s+to\s+anyone\s+to\s+use\s+this\s+software\s+for\s+any\s+purpose,\s+including\s+commercial\s+applications", 76, 0.93),
    ("curl", "curl license", r"curl\s+license", 55, 0.75),
    ("libpng-2.0", "png reference", r"png\s+reference\s+library\s+license\s+version\s+2", 76, 0.92),
    ("unicode", "unicode license", r"unicode\s+license\s+(?:agreement|v3)", 76, 0.9),
    # dedications and Creative Commons texts
    ("unlicense", "free and unencumbered", r"free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain", 77, 0.95),
    ("cc0-1.0", "waived all copyright", r"waived\s+all\s+copyright\s+and\s+related\s+or\s+neighbou?ring\s+rights", 77, 0.93),
    ("cc0-1.0", "universal public domain", r"universal\s+public\s+domain\s+dedication", 77, 0.92),
    ("public-domain", "placed in the", r"placed\s+in\s+the\s+public\s+domain", 58, 0.8),
    ("public-domain", "no rights reserved", r"no\s+rights\s+reserved", 45, 0.6),
    ("public-domain-mark", "public domain mark", r"public\s+domain\s+mark\s+1\.0", 60, 0.85),
    ("wtfpl", "do what the", r"do\s+what\s+the\s+fuck\s+you\s+want\s+to\s+public\s+license", 77, 0.95),
    ("cc-by-2.0", "creative commons", r"creative\s+commons\s+attribution\s+2\.0\s+(?:generic\s+)?licen[sc]e", 77, 0.93),
    ("cc-by-2.5", "creative commons", r"creative\s+commons\s+attribution\s+2\.5\s+(?:generic\s+)?licen[sc]e", 77, 0.93),
    ("cc-by-3.0", "creative commons", r"creative\s+commons\s+attribution\s+3\.0\s+(?:unported\s+)?licen[sc]e", 77, 0.93),
    ("cc-by-sa-3.0", "creative commons", r"creative\s+commons\s+attribution[\s-]share-?alike\s+3\.0\s+(?:unported\s+)?licen[sc]e", 78, 0.93),
    ("cc-by-nd-3.0", "creative commons", r"creative\s+commons\s+attribution[\s-]no-?deriv(?:ative)?s\s+3\.0\s+(?:unported\s+)?licen[sc]e", 78, 0.93),
    ("cc-by-nc-3.0", "creative commons", r"creative\s+commons\s+attribution[\s-]non-?commercial\s+3\.0\s+(?:unported\s+)?licen[sc]e", 78, 0.93),
    ("cc-by-nc-sa-3.0", "creative commons", r"creative\s+commons\s+attribution[\s-]non-?commercial[\s-]share-?alike\s+3\.0\s+(?:unported\s+)?licen[sc]e", 79, 0.93),
    ("cc-by-nc-sa-4.0", "creative commons", r"creative\s+commons\s+attribution[\s-]non-?commercial[\s-]share-?alike\s+4\.0\s+(?:international\s+)?(?:public\s+)?licen[sc]e", 79, 0.93),
    ("cc-by-nc-nd-4.0", "creative commons", r"creative\s+commons\s+attribution[\s-]non-?commercial[\s-]no-?derivatives\s+4\.0\s+(?:international\s+)?(?:public\s+)?licen[sc]e", 79, 0.93),
    ("cc-by", "creativecommons.org", r"creativecommons\.org/licenses/by/(?:1|2|3|4)\.0", 75, 0.9),
    ("cc-by-sa", "creativecommons.org", r"creativecommons\.org/licenses/by-sa/(?:1|2|3|4)\.0", 75, 0.9),
    ("cc-by-nc", "creativecommons.org", r"creativecommons\.org/licenses/by-nc/(?:1|2|3|4)\.0", 75, 0.9),
    ("cc-by-nd", "creativecommons.org", r"creativecommons\.org/licenses/by-nd/(?:1|2|3|4)\.0", 75, 0.9),
    ("odc-by-1.0", "open data commons", r"open\s+data\s+commons\s+attribution\s+license", 76, 0.92),
    ("pddl-1.0", "open data commons", r"open\s+data\s+commons\s+public\s+domain\s+dedication\s+(?:and|&)\s+license", 76, 0.92),
    ("cdla-permissive-2.0", "community data license", r"community\s+data\s+license\s+agreement\s+-\s+permissive", 76, 0.92),
    ("ogl-uk-3.0", "open government", r"open\s+government\s+licence\s+v?3\.0", 76, 0.92),
    # source-available and proprietary notices
    ("bsl-1.1", "business source", r"business\s+source\s+license,?\s+(?:version\s+)?1\.1", 76, 0.92),
    ("sspl-1.0", "server side public", r"server\s+side\s+public\s+license,?\s+(?:v|version)\s*1", 76, 0.92),
    ("elastic-2.0", "elastic license", r"elastic\s+license\s+2\.0", 76, 0.92),
    ("commons-clause", "commons clause", r"commons\s+clause\s+license\s+condition", 76, 0.92),
    ("polyform-noncommercial", "polyform", r"polyform\s+noncommercial\s+license", 76, 0.92),
    ("rail", "responsible ai", r"responsible\s+ai\s+license", 70, 0.85),
    ("proprietary", "proprietary and confidential", r"proprietary\s+and\s+confidential[.,]?\s+all\s+rights\s+reserved", 60, 0.75),
    ("proprietary", "end user", r"end[\s-]user\s+licen[sc]e\s+agreement", 60, 0.75),
    ("proprietary", "no part of", r"no\s+part\s+of\s+this\s+(?:book|publication|document|work)\s+may\s+be\s+reproduced\s+(?:or\s+transmitted\s+)?(?:in\s+any\s+form\s+)?without\s+(?:the\s+)?(?:prior\s+)?(?:written\s+)?permission", 60, 0.75),
    ("proprietary", "evaluation license", r"evaluation\s+license\s+agreement", 55, 0.7),
]


#: Every rule's pattern holds one of these, or the word "under".
CUES = ("licen", "spdx", "permission", "redistribution", "rights", "domain", "subject", "governed", "covered", "acknowledg")


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keywords, pattern, rank, confidence), strongest first; patterns stand at word borders."""
    found = [(label, key, form.replace("{n}", f"(?:{name})"), rank, sure) for label, key, name in NAMES for form, rank, sure in FORMS]
    return sorted(found + OTHERS + SENTENCES, key=lambda r: (-r[3], r[0], r[2]))


def _gate(keys: list[str]) -> str:
    """A pattern of all gate keywords, by their first letters, so that most words are passed over at once."""
    words = sorted({k.replace(".", r"\.").replace(" ", r"\s+") for some in keys for k in some.split("|")}, key=lambda k: (-len(k), k))
    first = sorted({k[0] for k in words})
    return r"(?i)\b(" + "|".join(f"{c}(?:{'|'.join(k[1:] for k in words if k[0] == c)})" for c in first) + ")"


def cued(text: Column, low: Column) -> Column:
    """Whether any rule could match; plain searches in the lower-case text decide for most texts."""
    found = low.contains("under") & text.rlike("(?i)\\bunder\\s")
    for cue in CUES:
        found = low.contains(cue) | found
    return found


def keywords(text: Column, low: Column) -> Column:
    """The gate keywords (their first words) that a text holds; low is the text in lower case."""
    found = F.regexp_extract_all(text, F.lit(_gate([r[1] for r in rules()])), F.lit(1))
    first = F.array_distinct(F.transform(found, lambda k: F.regexp_extract(F.lower(k), r"^\S+", 0)))
    return F.when(cued(text, low), first).otherwise(F.array().cast("array<string>"))


def detections(text: Column, keys: Column) -> Column:
    """array<struct<start, stop, rank, label, sure>> of a text's surviving detections, by place.

    keys is a column that holds keywords(); it is looked at once for each rule.

    Of equal spans the strongest rule stays. A span within another one goes. Of two survivors that
    overlap, the one of lower rank goes, the later one on equal ranks.
    """
    known = rules()
    rows = [{"keys": [x.split(" ")[0] for x in k.split("|")], "scan": rf"(?is)\G(.*?)(\b{p}(?!\w))", "pattern": rf"(?is)\b{p}(?!\w)", "rank": rank, "label": label, "sure": sure} for label, k, p, rank, sure in known]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<keys:array<string>,scan:string,pattern:string,rank:int,label:string,sure:double>>")
    span = "struct<start:int,stop:int,rank:int,label:string,sure:double>"

    def spans(rule: Column) -> Column:
        gaps = F.regexp_extract_all(text, rule["scan"], F.lit(1))
        hits = F.regexp_extract_all(text, rule["scan"], F.lit(2))

        def step(at: Column, pair: Column) -> Column:
            start = at["at"] + F.length(pair["0"])
            stop = start + F.length(pair["1"])
            own = F.struct(start.alias("start"), stop.alias("stop"), rule["rank"].alias("rank"), rule["label"].alias("label"), rule["sure"].alias("sure"))
            return F.struct(stop.alias("at"), F.concat(at["out"], F.array(own)).alias("out"))

        nothing = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out"))
        return F.aggregate(F.arrays_zip(gaps.alias("0"), hits.alias("1")), nothing, step, lambda at: at["out"])

    found = F.flatten(F.transform(F.filter(table, lambda r: F.arrays_overlap(keys, r["keys"]) & F.regexp_like(text, r["pattern"])), spans))
    ordered = F.array_sort(found, lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["stop"] != b["stop"], F.when(a["stop"] > b["stop"], -1).otherwise(1)).when(a["rank"] != b["rank"], F.when(a["rank"] > b["rank"], -1).otherwise(1)).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0))
    outer = F.aggregate(ordered, F.struct(F.lit(-1).alias("end"), F.array().cast(f"array<{span}>").alias("out")), lambda at, x: F.when(x["stop"] <= at["end"], at).otherwise(F.struct(x["stop"].alias("end"), F.concat(at["out"], F.array(x)).alias("out"))), lambda at: at["out"])
    last = lambda at: F.get(at, F.size(at) - 1)
    settled = F.aggregate(
        outer,
        F.array().cast(f"array<{span}>"),
        lambda at, x: F.when((F.size(at) == 0) | (last(at)["stop"] <= x["start"]), F.concat(at, F.array(x))).when(last(at)["rank"] >= x["rank"], at).otherwise(F.concat(F.slice(at, 1, F.size(at) - 1), F.array(x))),
    )
    return F.when(F.size(keys) > 0, settled).otherwise(F.array().cast(f"array<{span}>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Words are runs of characters outside BREAKS, numbered from 0; base phrases ignore the case of A-Z.
    first_word and last_word are the first words of the first and last base phrase, else null. labels
    joins the base labels and those of the detections. score is the confidence of the surest detection,
    0.6 for a base phrase without one, else 0. Null texts are empty; other columns are not read.
    """
    word, gap = f"[^{BREAKS}]", f"[{BREAKS}]+"
    phrase = lambda p: gap.join(p.split(" "))
    whole = f"(?is)(?<!{word})(?:{'|'.join(map(phrase, BASE))})(?!{word})"
    lead = lambda some: f"(?is)^({some})(?<!{word})(?:{'|'.join(map(phrase, BASE))})(?!{word})"
    text, low = F.col("__text"), F.col("__low")
    has = F.col("n_base") > 0
    rows = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")).withColumn("__low", F.lower("__text"))
    rows = rows.withColumn("__keys", keywords(text, low))
    # Every base phrase ends with this word.
    n_base = F.when(low.contains("license"), F.regexp_count(text, F.lit(whole)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    rows = rows.select("*", F.regexp_count(text, F.lit(f"{word}+")).cast("bigint").alias("n_words"), n_base.alias("n_base"), detections(text, F.col("__keys")).alias("detections"))
    before = lambda some: F.when(has, F.regexp_count(F.regexp_extract(text, lead(some), 1), F.lit(f"{word}+")).cast("bigint"))
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(has & text.rlike(f"(?is)(?<!{word}){phrase(p)}(?!{word})"), F.lit(label)) for p, label in BASE.items())))))
    rows = rows.select(id_col, "n_words", "n_base", before(".*?").alias("first_word"), before(".*").alias("last_word"), base.alias("base"), "detections")
    labels = F.array_sort(F.array_union("base", F.transform("detections", lambda d: d["label"])))
    sure = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["sure"])), F.lit(0.0)), F.when(F.size("base") > 0, 0.6).otherwise(0.0))
    return rows.select(id_col, "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), sure.alias("score"), "detections")
