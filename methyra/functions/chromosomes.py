"""Chromosome lengths of the genome builds that are allowed by default."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Published lengths of chromosomes 1, 2, ... and X, Y, M of each assembly.
HG38 = (
    248956422, 242193529, 198295559, 190214555, 181538259, 170805979, 159345973, 145138636, 138394717, 133797422, 135086622, 133275309,
    114364328, 107043718, 101991189, 90338345, 83257441, 80373285, 58617616, 64444167, 46709983, 50818468, 156040895, 57227415, 16569,
)
HG19 = (
    249250621, 243199373, 198022430, 191154276, 180915260, 171115067, 159138663, 146364022, 141213431, 135534747, 135006516, 133851895,
    115169878, 107349540, 102531392, 90354753, 81195210, 78077248, 59128983, 63025520, 48129895, 51304566, 155270560, 59373566, 16571,
)
MM9 = (
    197195432, 181748087, 159599783, 155630120, 152537259, 149517037, 152524553, 131738871, 124076172, 129993255, 121843856, 121257530,
    120284312, 125194864, 103494974, 98319150, 95272651, 90772031, 61342430, 166650296, 15902555, 16302,
)
MM10 = (
    195471971, 182113224, 160039680, 156508116, 151834684, 149736546, 145441459, 129401213, 124595110, 130694993, 122082543, 120129022,
    120421639, 124902244, 104043685, 98207768, 94987271, 90702639, 61431566, 171031299, 91744698, 16299,
)
MM39 = (
    195154279, 182045439, 160039680, 156508116, 151753680, 149588044, 144995196, 130127694, 124359700, 130530862, 122014644, 120129022,
    120421639, 124902244, 104043685, 98207768, 94987271, 90702639, 61420004, 169476592, 91455967, 16299,
)
RN6 = (
    282763074, 266435125, 171537068, 187126005, 173096209, 147636619, 143002779, 129041809, 113440130, 110718848, 81197504, 46294695,
    111066128, 112194335, 109758686, 90238779, 97296396, 87333570, 59216772, 55268282, 159970021, 20274243, 16313,
)
RN7 = (
    267954042, 258207540, 173375984, 187972056, 175772099, 149603403, 144431168, 131738167, 114928760, 113744950, 85155652, 46771159,
    111571696, 112958639, 109692580, 90843739, 97852489, 88359747, 60773175, 55860226, 161629489, 18860971, 16313,
)
LENGTHS = {"GRCh37": HG19, "GRCh38": HG38, "hg19": HG19, "hg38": HG38, "mm9": MM9, "mm10": MM10, "mm39": MM39, "rn6": RN6, "rn7": RN7}


def rows() -> list[tuple[str, str, int]]:
    """(build, chromosome, length) of all builds."""
    named = lambda n: [f"chr{i}" for i in (*range(1, n - 2), "X", "Y", "M")]
    return [(build, c, x) for build, lengths in LENGTHS.items() for c, x in zip(named(len(lengths)), lengths)]


def sizes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "build string, chrom string, length long")
