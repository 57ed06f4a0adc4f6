"""Whole licence files, as projects ship them, are found by name."""

from pathlib import Path

from tessera.llm import license_texts
from tessera.llm.license_digests import known_licenses, scan_licenses


def test_whole_files(spark):
    mit, zlib, bsd = (license_texts.KNOWN[n][0] for n in ("MIT", "Zlib", "BSD-2-Clause"))
    third = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE"
    rows = [("MIT", f"MIT License\n\nCopyright (c) 2020 Some One\n\n{mit}"), ("Zlib", f"zlib License\n\n(C) 2001 me\n\n{zlib}"), ("BSD-3-Clause", f"BSD 3-Clause License\n\n{bsd.replace('THIS SOFTWARE', third, 1)}")]
    folder = Path(license_texts.__file__).parent / "licenses"
    for name in ("Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "MPL-2.0", "CC-BY-SA-4.0"):
        rows.append((name, (folder / f"{name}.txt").read_text() if (folder / f"{name}.txt").exists() else name))
    rows.append(("Apache-2.0", rows[3][1].partition("APPENDIX")[0]))
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in scan_licenses(docs, known_licenses(spark)).collect()}
    assert [got[k] for k in range(len(rows))] == [name for name, _ in rows]
