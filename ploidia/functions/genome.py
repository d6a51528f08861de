"""Chromosome order and gene name rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Autosomes in canonical order, and what is never used for calls.
AUTOSOMES = [f"chr{n}" for n in range(1, 23)]
CONTIGS = [*AUTOSOMES, "chrX", "chrY", "chrM", "chrMT"]
DROP_CHROMS = ("chrX", "chrY", "chrM", "chrMT")
DROP_PREFIXES = ("MT-", "HLA-")
IG_LOCI = {"IGH": "chr14", "IGK": "chr2", "IGL": "chr22"}

# Cell-cycle genes of Tirosh et al. 2016 (S and G2/M) with current aliases.
CYCLE_GENES = """
MCM5 PCNA TYMS FEN1 MCM2 MCM4 RRM1 UNG GINS2 MCM6 CDCA7 DTL PRIM1 UHRF1 MLF1IP CENPU HELLS RFC2 RPA2 NASP RAD51AP1
GMNN WDR76 SLBP CCNE2 UBR7 POLD3 MSH2 ATAD2 RAD51 RRM2 CDC45 CDC6 EXO1 TIPIN DSCC1 BLM CASP8AP2 USP1 CLSPN POLA1
CHAF1B BRIP1 E2F8 HMGB2 CDK1 NUSAP1 UBE2C BIRC5 TPX2 TOP2A NDC80 CKS2 NUF2 CKS1B MKI67 TMPO CENPF TACC3 FAM64A PIMREG
SMC4 CCNB2 CKAP2L CKAP2 AURKB BUB1 KIF11 ANP32E TUBB4B GTSE1 KIF20B HJURP CDCA3 HN1 JPT1 CDC20 TTK CDC25C KIF2C
RANGAP1 NCAPD2 DLGAP5 CDCA2 CDCA8 ECT2 KIF23 HMMR AURKA PSRC1 ANLN LBR CKAP5 CENPE CTCF NEK2 G2E3 GAS2L3 CBX5 CENPA
""".split()

# Marker genes of cell types, in order (the order breaks ties), and those taken as diploid.
SIGNATURES = {
    "T_cell": "CD3D CD3E CD3G CD2 TRAC TRBC1 TRBC2 CD8A CD8B CD4".split(),
    "B_cell": "CD79A CD79B MS4A1 CD19 CD22 BANK1 BLK IGHM IGHD".split(),
    "NK_cell": "GNLY NKG7 KLRD1 KLRF1 NCR1 NCAM1 FCGR3A PRF1".split(),
    "Myeloid": "CD68 CD163 LYZ CSF1R CSF3R AIF1 FCER1G C1QA C1QB C1QC S100A8 S100A9".split(),
    "Neutrophil": "FCGR3B CSF3R CXCR2 CEACAM3 FUT4 FFAR2 CMTM2 G0S2 S100A8 S100A9".split(),
    "Plasma_cell": "MZB1 JCHAIN IGHA1 IGHG1 XBP1 CD38 DERL3 FKBP11".split(),
    "Endothelial": "PECAM1 VWF CDH5 CLDN5 KDR FLT1 EGFL7 PLVAP ESAM".split(),
    "Fibroblast": "COL1A1 COL1A2 COL3A1 DCN LUM PDGFRA FAP ACTA2 POSTN SPARC FN1 VIM S100A4 THY1".split(),
    "Pericyte": "RGS5 PDGFRB CSPG4 NOTCH3 ANPEP CD146 MCAM ACTA2 MYH11 TAGLN".split(),
    "Osteoblast": "RUNX2 SP7 COL1A1 COL1A2 IBSP BGLAP ALPL SPP1 PHEX DMP1".split(),
    "Smooth_muscle": "ACTA2 MYH11 CNN1 TAGLN MYOCD SRF LMOD1".split(),
}
NON_MALIGNANT = ["T_cell", "B_cell", "NK_cell", "Myeloid", "Neutrophil", "Endothelial", "Pericyte", "Osteoblast", "Smooth_muscle"]


def chr_rank(chrom: Column) -> Column:
    """0-based canonical position; NULL for contigs that have none."""
    at = F.array_position(F.array(*[F.lit(c) for c in CONTIGS]), chrom)
    return F.when(at > 0, (at - 1).cast("int"))


def placeable(symbol: Column, chrom: Column, drop_prefixes=DROP_PREFIXES, drop_chroms=DROP_CHROMS, ig_loci=None) -> Column:
    """The name and chromosome rules, without the cell-cycle set."""
    keep = chrom.isNotNull() & ~chrom.isin(*drop_chroms) if drop_chroms else chrom.isNotNull()
    for p in drop_prefixes:
        keep = keep & ~symbol.startswith(p)
    for p, c in (IG_LOCI if ig_loci is None else ig_loci).items():
        keep = keep & ~(symbol.startswith(p) & (chrom == c))
    return keep
