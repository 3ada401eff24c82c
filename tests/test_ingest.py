"""Readers on a few hand-written lines."""

from helixloom.sources import ingest as S

HEADER = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tKIM\n"
RECORDS = [
    "22 4711 . TTA T 33.5 PASS DP=9 GT:DP:AD 1|1:9:0,9",
    "chr22 4800 rs77 G A,C,T 12 LowQual . GT:AD:GQ:VAF 1|3:2,5,0,6:17:0.38,0,0.46",
    "chrUn_x 9 . C . . . . GT .",
    "chrY 61 . A T 7 NoCall . GT:GQ ./.:.",
]


def test_read_and_split(spark, tmp_path):
    (tmp_path / "kim.vcf").write_text(HEADER + "".join(r.replace(" ", "\t") + "\n" for r in RECORDS))
    v = S.split_multiallelic(S.read_vcf(spark, str(tmp_path / "kim.vcf")))
    got = {(r["chrom_order"], r["pos"], r["alt"]): (r["gt"], r["gq"], r["ad_ref"], r["ad_alt"], r["vaf"], r["multiallelic"]) for r in v.collect()}
    assert got.pop((99, 9, "."))[1:] == (None, None, None, None, False)
    assert got == {
        (21, 4711, "T"): ("1|1", None, 0, 9, None, False),
        (21, 4800, "A"): ("1|0", 17, 2, 5, 0.38, True),
        (21, 4800, "C"): ("0|0", 17, 2, 0, 0.0, True),  # not passing, so the row of an allele that is not carried stays
        (21, 4800, "T"): ("0|1", 17, 2, 6, 0.46, True),
        (23, 61, "T"): ("./.", None, None, None, None, False),
    }


def test_intervals_and_genes(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track x\nchr2\t10\t20\n#c\nMT\t0\t5\n")
    assert sorted(map(tuple, S.read_intervals(spark, str(tmp_path / "a.bed")).collect())) == [("2", 10, 20), ("MT", 0, 5)]
    (tmp_path / "a.gff").write_text("#h\n1\tx\tgene\t5\t9\t.\t+\t.\tName=AB;biotype=protein_coding;description=a%20thing [Source:x]\n1\tx\texon\t5\t9\t.\t+\t.\tName=E\n")
    assert list(map(tuple, S.read_gene_models(spark, str(tmp_path / "a.gff")).collect())) == [("AB", "protein_coding", "1", 5, 9, "a thing")]


def test_conform(spark):
    df = S.conform(spark.createDataFrame([(1, "x")], "a int, z string"), "a long, b string")
    assert df.columns == ["a", "b"] and tuple(df.first()) == (1, None)
