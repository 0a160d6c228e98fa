"""Known licence sentences and the ordered rules over them."""

from __future__ import annotations

#: Sentences of public licences and notices, by identifier. Those of numbered families follow below.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-name": "Released under the MIT License.",
    "mit-name-2": "Licensed under the MIT License.",
    "mit-name-3": "This project is licensed under the MIT License.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-name": "Released under the ISC License.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-name-2": "Licensed under the BSD 2-Clause License.",
    "bsd-name-3": "Licensed under the BSD 3-Clause License.",
    "apache-2-name": "Licensed under the Apache License, Version 2.0.",
    "apache-2-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-2-comply": "you may not use this file except in compliance with the License.",
    "apache-2-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl-free": "This program is free software:",
    "gpl-free-2": "This program is free software;",
    "gpl-useful": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "mpl-2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "public-domain": "This work is in the public domain.",
    "cc0-name": "This work is dedicated to the public domain under CC0 1.0.",
    "all-rights": "All rights reserved.",
    "proprietary": "Unauthorized copying of this file, via any medium is strictly prohibited.",
}

#: Rules as (licence, identifiers in order), the more specific before the more general.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-name"]), ("MIT", ["mit-name-2"]), ("MIT", ["mit-name-3"]),
    ("ISC", ["isc-grant"]), ("ISC", ["isc-name"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-2-Clause", ["bsd-name-2"]), ("BSD-3-Clause", ["bsd-name-3"]),
    ("Apache-2.0", ["apache-2-header", "apache-2-comply", "apache-2-copy", "apache-2-as-is", "apache-2-see"]),
    ("Apache-2.0", ["apache-2-header", "apache-2-comply"]),
    ("Apache-2.0", ["apache-2-name"]),
    ("MPL-2.0", ["mpl-2-form"]),
    ("Unlicense", ["unlicense"]),
    ("CC0-1.0", ["cc0-name"]),
    ("LicenseRef-proprietary", ["all-rights", "proprietary"]),
    ("LicenseRef-proprietary", ["proprietary"]),
    ("LicenseRef-public-domain", ["public-domain"]),
    ("LicenseRef-all-rights-reserved", ["all-rights"]),
]


def _families() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    sentences, rules = {}, []
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for version in ("2.0", "2.5", "3.0", "4.0"):
            for i, text in enumerate(("Licensed under CC {}.", "This work is licensed under CC {}.", "Released under CC {}.")):
                name = f"cc-{kind.lower()}-{version}-{i}"
                sentences[name] = text.format(f"{kind} {version}")
                rules.append((f"CC-{kind}-{version}", [name]))
    published = (("GPL", "GNU General Public License", ("1", "2", "3")), ("LGPL", "GNU Lesser General Public License", ("2", "2.1", "3")),
                 ("AGPL", "GNU Affero General Public License", ("1", "3")))
    for short, long, versions in published:
        for version in versions:
            listed = f"{short}-{version if '.' in version else version + '.0'}"
            for i, text in enumerate(("This work is licensed under the {}, version {}.", "Licensed under the {}, version {}.", "Released under the {}, version {}.")):
                name = f"{short.lower()}-{version}-name-{i}"
                sentences[name] = text.format(long, version)
                rules.append((listed, [name]))
            terms = f"{short.lower()}-{version}-terms"
            sentences[terms] = f"you can redistribute it and/or modify it under the terms of the {long} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
            for free in ("gpl-free", "gpl-free-2"):
                rules.insert(0, (f"{listed}-or-later", [free, terms, "gpl-useful", "gpl-implied", "gpl-details"]))
                rules.append((f"{listed}-or-later", [free, terms]))
            rules.append((f"{listed}-or-later", [terms]))
    return sentences, rules


def known() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """All sentences by identifier, and all rules, first the most specific."""
    sentences, rules = _families()
    return SENTENCES | sentences, sorted(RULES + rules, key=lambda r: -len(r[1]))
