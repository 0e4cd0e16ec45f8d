"""Ordinary notices and heads of licence files."""

import textwrap

from tesselon.llm.licences import SENTENCES, licences

BSD = "\n".join(SENTENCES[k] for k in ("bsd-1", "bsd-2", "bsd-3"))
NOTICES = {
    "// SPDX-License-Identifier: GPL-2.0": "GPL-2.0-only",
    "# SPDX-License-Identifier: GPL-2.0+": "GPL-2.0-or-later",
    "/* SPDX-License-Identifier: LGPL-3.0-only */": "LGPL-3.0-only",
    "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/": "Apache-2.0",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007": "GPL-3.0-only",
    SENTENCES["isc-2"]: "ISC",
    "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.": "GPL-2.0-only",
    "This project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details.": "MIT",
    "This project is licensed under the MIT License - see the LICENSE file for details": "MIT",
    "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0",
    "Available under CC BY 4.0": "CC-BY-4.0",
    BSD: "BSD-2-Clause",
    BSD + "\n" + SENTENCES["bsd-4"].replace("the copyright holder", "Example Widgets, Inc."): "BSD-3-Clause",
    "\n".join(textwrap.wrap(BSD + " 3. " + SENTENCES["bsd-4"].replace("the copyright holder", "the University of Nowhere"), 72)): "BSD-3-Clause",
    "neither the name of the rose nor any other": "",
    "It is licensed under terms that nobody knows. Version 3, 29 June 2007": "",
}


def test_notices(spark):
    df = spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licences(df).collect()}
    assert got == dict(enumerate(NOTICES.values()))
