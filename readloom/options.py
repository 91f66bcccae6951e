"""All settings of a run with their defaults, and their checks."""

from __future__ import annotations

from dataclasses import dataclass, fields

from readloom.operators.umi import LOCATIONS


class OptionError(ValueError):
    pass


@dataclass(frozen=True)
class Options:
    # input and output
    in_file1: str = ""
    in_file2: str = ""
    out_file1: str = ""
    out_file2: str = ""
    keep_order: bool = True
    compress_level: int = 4
    overwrite: bool = False
    phred64: bool = False
    interleaved_in: bool = False
    interleaved_out: bool = False
    long_reads: bool = False
    insert_size: bool = True
    # adapters
    trim_adapter: bool = True
    detect_single: bool = True
    detect_paired: bool = False
    list_trimmed: bool = False
    adapter1: str = ""
    adapter2: str = ""
    adapter_file: str = ""
    adapter_length_limit: int = 0
    # trimming
    cut5: bool = False
    cut3: bool = False
    cut_window: int = 4
    cut_quality: int = 20
    front1: int = 0
    tail1: int = 0
    front2: int = 0
    tail2: int = 0
    poly_g: bool = False
    poly_x: bool = False
    poly_length: int = 10
    # filtering; these have no flag on a command line but are parameters here
    shortest: int = 15
    longest: int = 500
    low_quality: int = 15
    low_percent: int = 40
    most_n: int = 5
    # UMI
    umi: bool = False
    umi_length: int = 0
    umi_location: str = ""
    umi_prefix: str = ""
    umi_skip: int = 0
    # over-represented sequences
    overrepresented: bool = False
    overrepresented_sampling: int = 20
    # overlap of mates
    correct_overlap: bool = False
    overlap_differences: int = 5
    overlap_bases: int = 30
    # error correction
    correct_reads: bool = False
    pair_mode: str = "SE"
    coverage: int = 30
    hashmaps: int = 48
    kmer_length: int = 0
    quality_scores: bool = False
    quality_bits: int = 8
    exclude_ambiguous: bool = False
    max_mismatch_ratio: float = 0.2
    min_overlap: int = 30
    min_overlap_ratio: float = 0.3
    error_factor: float = 0.06
    coverage_factor: float = 0.6
    fixed_reads: int = 0
    quality_labels: bool = False
    correct_candidates: bool = False
    candidate_columns: int = 15
    correction_type: int = 0
    correction_type_candidates: int = 0
    # snapshots of the corrector: folders of prepared reads and of signatures
    save_reads: str = ""
    load_reads: str = ""
    save_signatures: str = ""
    load_signatures: str = ""
    # over-represented sequences as a table next to the output
    print_overrepresented: bool = False

    @property
    def phred(self) -> int:
        return 64 if self.phred64 else 33

    @property
    def paired(self) -> bool:
        return bool(self.in_file2) or self.interleaved_in

    def checked(self) -> Options:
        """These options with paired front and tail resolved, or OptionError."""
        from dataclasses import replace

        o = self
        if o.umi:
            if o.umi_location not in LOCATIONS:
                raise OptionError(f"umi_location must be one of {', '.join(LOCATIONS)}")
            if o.umi_location in ("read1", "read2", "per_read") and o.umi_length <= 0:
                raise OptionError("umi_length must be positive if the UMI is in a read")
        if not 1 <= o.compress_level <= 9:
            raise OptionError("compress_level must be from 1 to 9")
        if o.interleaved_in and o.in_file2:
            raise OptionError("interleaved input is one file")
        if bool(o.in_file2) and not o.in_file1:
            raise OptionError("a second file needs a first one")
        if o.in_file1 and o.in_file2 and o.in_file1.endswith(".gz") != o.in_file2.endswith(".gz"):
            raise OptionError("both mates must be compressed alike")
        if o.long_reads and (o.paired or o.out_file1):
            raise OptionError("long reads have statistics only, of one file")
        for name in ("front1", "tail1", "front2", "tail2", "umi_length", "umi_skip", "shortest", "most_n"):
            if getattr(o, name) < 0:
                raise OptionError(f"{name} must not be negative")
        if o.pair_mode not in ("SE", "PE"):
            raise OptionError("pair_mode must be SE or PE")
        if not 0 < o.max_mismatch_ratio <= 1 or not 0 < o.min_overlap_ratio <= 1:
            raise OptionError("ratios must lie in (0, 1]")
        if o.quality_bits not in (1, 2, 8):
            raise OptionError("quality_bits must be 1, 2 or 8")
        if o.correction_type not in (0, 1, 2) or o.correction_type_candidates not in (0, 1, 2):
            raise OptionError("correction types are 0, 1, 2")
        if not 1 <= o.hashmaps or not 0 <= o.kmer_length <= 32:
            raise OptionError("hashmaps must be positive, kmer_length at most 32")
        if o.print_overrepresented and not (o.overrepresented and o.out_file1):
            raise OptionError("over-represented sequences are printed beside an output and need their search")
        if o.overrepresented_sampling < 1:
            raise OptionError("overrepresented_sampling must be positive")
        # In pairs what is set for mate 1 holds for mate 2 too.
        return replace(o, front2=o.front1 or o.front2, tail2=o.tail1 or o.tail2) if o.paired else o


#: Flags of the command line: flag -> (field, value or None if it takes one).
FLAGS = {
    "-i": ("in_file1", None), "--inFile1": ("in_file1", None), "-I": ("in_file2", None), "--inFile2": ("in_file2", None),
    "-o": ("out_file1", None), "--outFile1": ("out_file1", None), "-O": ("out_file2", None), "--outFile2": ("out_file2", None),
    "--notKeepOrder": ("keep_order", False), "--compressLevel": ("compress_level", None), "--overWrite": ("overwrite", True), "--phred64": ("phred64", True),
    "--TGS": ("long_reads", True), "--noInsertSize": ("insert_size", False), "--interleavedIn": ("interleaved_in", True), "--interleavedOut": ("interleaved_out", True),
    "-a": ("trim_adapter", False), "--noTrimAdapter": ("trim_adapter", False), "--decAdaForSe": ("detect_single", True), "--decAdaForPe": ("detect_paired", True), "--printWhatTrimmed": ("list_trimmed", True),
    "--adapterSeq1": ("adapter1", None), "--adapterSeq2": ("adapter2", None), "--adapterFastaFile": ("adapter_file", None),
    "-5": ("cut5", True), "--trim5End": ("cut5", True), "-3": ("cut3", True), "--trim3End": ("cut3", True),
    "--trimFront1": ("front1", None), "--trimFront2": ("front2", None), "--trimTail1": ("tail1", None), "--trimTail2": ("tail2", None),
    "-g": ("poly_g", True), "--trimPolyg": ("poly_g", True), "-x": ("poly_x", True), "--trimPolyx": ("poly_x", True),
    "-u": ("umi", True), "--addUmi": ("umi", True), "--umiLen": ("umi_length", None), "--umiLoc": ("umi_location", None), "--umiPrefix": ("umi_prefix", None), "--umiSkip": ("umi_skip", None),
    "-p": ("overrepresented", True), "--doOverrepresentation": ("overrepresented", True), "-P": ("overrepresented_sampling", None), "--overrepresentationSampling": ("overrepresented_sampling", None),
    "--correctData": ("correct_overlap", True), "--correctReads": ("correct_reads", True), "--pairmode": ("pair_mode", None), "--coverage": ("coverage", None), "--hashmaps": ("hashmaps", None), "--kmerlength": ("kmer_length", None),
    "--useQualityScores": ("quality_scores", True), "--qualityScoreBits": ("quality_bits", None), "--excludeAmbiguous": ("exclude_ambiguous", True), "--maxmismatchratio": ("max_mismatch_ratio", None),
    "--minalignmentoverlap": ("min_overlap", None), "--minalignmentoverlapratio": ("min_overlap_ratio", None), "--errorfactortuning": ("error_factor", None), "--coveragefactortuning": ("coverage_factor", None),
    "--fixedNumberOfReads": ("fixed_reads", None), "--correctionQualityLabels": ("quality_labels", True), "--candidateCorrection": ("correct_candidates", True), "--candidateCorrectionNewColumns": ("candidate_columns", None),
    "--save-preprocessedreads-to": ("save_reads", None), "--load-preprocessedreads-from": ("load_reads", None), "--save-hashtables-to": ("save_signatures", None), "--load-hashtables-from": ("load_signatures", None), "--printORPSeqs": ("print_overrepresented", True),
    "--correctionType": ("correction_type", None), "--correctionTypeCands": ("correction_type_candidates", None),
}

#: Flags that tune threads, memory or temporary files; Spark's own settings do that here. True: takes a value.
WITHOUT_EFFECT = {"-w": True, "--threadNum": True, "--enforceHashmapCount": False, "--showProgress": False, "--tempdir": True, "--memHashtables": True, "--memTotal": True, "--hashloadfactor": True, "--singlehash": False}
#: Flags that would need the standard streams of one machine; they are refused, since ignoring them would lose data.
REFUSED = {"--stdin": "give the path of a file or folder", "--stdout": "give the path of an output folder"}


def parse(arguments: list[str], ignore: dict[str, bool] | None = None) -> Options:
    """Options from command-line arguments; unknown ones are refused unless `ignore` names them (True: with a value)."""
    ignored = WITHOUT_EFFECT | (ignore or {})
    kinds = {f.name: f.type for f in fields(Options)}
    values: dict[str, object] = {}
    rest = list(arguments)
    while rest:
        flag, _, given = rest.pop(0).partition("=")
        if flag in ignored:
            if ignored[flag] and not given and rest:
                rest.pop(0)
            continue
        if flag in REFUSED:
            raise OptionError(f"{flag} has no meaning on a cluster: {REFUSED[flag]}")
        if flag not in FLAGS:
            raise OptionError(f"unknown option {flag}")
        name, value = FLAGS[flag]
        if value is None:
            if not given and not rest:
                raise OptionError(f"{flag} needs a value")
            text = given or rest.pop(0)
            try:
                value = {"int": int, "float": float, "str": str}[str(kinds[name])](text)
            except ValueError:
                raise OptionError(f"{flag}: {text} is not a number") from None
        values[name] = value
    return Options(**values).checked()
