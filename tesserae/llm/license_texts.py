"""Texts of public licences and the names they go by.

Fixed values: what stands here are openings and conditions of the licences as their stewards
publish them, and their usual names, by which notices are put together.
"""

from __future__ import annotations

#: name, label, text, mandatory key phrases
TEXTS = (
    ("mit-text", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ("permission is hereby granted free of charge to any person obtaining a copy",)),
    ("mit-opening", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ("permission is hereby granted free of charge to any person obtaining a copy",)),
    ("isc-opening", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose", ("permission to use copy modify and or distribute this software",)),
    ("bsd-opening", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("redistribution and use in source and binary forms with or without modification",)),
    ("isc-text", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("permission to use copy modify and or distribute this software",)),
    ("bsd-text", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ("redistribution and use in source and binary forms with or without modification",)),
    ("bsd-3-clause", "bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("neither the name of", "endorse or promote products derived from this software")),
    ("apache-text", "apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", ("licensed under the apache license version 2",)),
    ("gpl-text", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("under the terms of the gnu general public license as published by the free software foundation",)),
    ("lgpl-text", "lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ("under the terms of the gnu lesser general public license as published by the free software foundation",)),
    ("agpl-text", "agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("under the terms of the gnu affero general public license as published by the free software foundation",)),
    ("mpl-text", "mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ("subject to the terms of the mozilla public license",)),
    ("zlib-text", "zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", ("permission is granted to anyone to use this software for any purpose including commercial applications",)),
    ("boost-text", "boost-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so", ("free of charge to any person or organization obtaining a copy of the software",)),
    ("unlicense-text", "unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("free and unencumbered software released into the public domain",)),
    ("cc0-text", "cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ("waived all copyright and related or neighboring rights",)),
    ("reserved", "all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)
#: label and names that stand behind "under the" in notices; of a family, those with a version
NAMES = (
    ("mit", "mit license"), ("isc", "isc license"), ("bsd", "bsd license"), ("bsd-2", "2 clause bsd license"), ("bsd-3", "3 clause bsd license"),
    ("apache-2", "apache license version 2"), ("gpl-2", "gnu general public license version 2"), ("gpl-3", "gnu general public license version 3"),
    ("lgpl-2", "gnu lesser general public license version 2 1"), ("lgpl-3", "gnu lesser general public license version 3"),
    ("agpl-3", "gnu affero general public license version 3"), ("gfdl", "gnu free documentation license"),
    ("mpl-2", "mozilla public license version 2 0"), ("epl-2", "eclipse public license v 2 0"),
    ("cddl", "common development and distribution license"), ("zlib", "zlib license"), ("boost-1", "boost software license"), ("artistic-2", "artistic license 2 0"),
    ("eupl", "european union public licence"), ("ofl", "sil open font license"), ("unlicense", "unlicense"), ("wtfpl", "do what the fuck you want to public license"), ("odbl", "open database license"),
)
VERBS = ("licensed", "released", "distributed", "available", "provided")
#: label and conditions of the licences named by letters, behind "cc"
LETTERS = (("cc-by", "by 4 0"), ("cc-by-sa", "by sa 4 0"), ("cc-by-nc", "by nc 4 0"), ("cc-by-nd", "by nd 4 0"), ("cc-by-nc-sa", "by nc sa 4 0"), ("cc-by-nc-nd", "by nc nd 4 0"), ("cc0", "0 1 0"))
#: label and identifier in file headers, as words
IDENTIFIERS = (("mit", "mit"), ("apache-2", "apache 2 0"), ("bsd-2", "bsd 2 clause"), ("bsd-3", "bsd 3 clause"), ("isc", "isc"), ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"), ("lgpl-2", "lgpl 2 1"), ("lgpl-3", "lgpl 3 0"), ("agpl-3", "agpl 3 0"), ("mpl-2", "mpl 2 0"), ("epl-2", "epl 2 0"), ("cc0", "cc0 1 0"), ("unlicense", "unlicense"), ("boost-1", "bsl 1 0"), ("zlib", "zlib"))
