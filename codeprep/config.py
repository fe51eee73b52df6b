"""Dataset versions and job settings."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TableLayout:
    """Where one raw table lies under the dataset folder and how its CSV is read."""

    path: str
    multiline: bool = False


@dataclass(frozen=True)
class DatasetVersion:
    """Everything that differs between the two supported dataset versions."""

    name: str
    note_key: str
    kind_col: str
    discharge_kind: str
    code_col: str
    code_system: str
    layout: dict[str, TableLayout] = field(hash=False, compare=False)
    csv_notes: str = ""
    csv_codes: str = ""

    @property
    def database(self) -> str:
        return self.name.replace("-", "_")

    @property
    def metadata_kind(self) -> str:
        """Name of the note-kind field inside an example's metadata."""
        return self.kind_col.lower()


# Table locations, filter values and column names of the two public datasets.
MIMIC_III = DatasetVersion(
    name="mimic-iii",
    note_key="NOTE_PK",
    kind_col="CATEGORY",
    discharge_kind="Discharge summary",
    code_col="ICD9_CODE",
    code_system="ICD-9",
    layout={
        "NOTEEVENTS": TableLayout("NOTEEVENTS.csv", multiline=True),
        "DIAGNOSES_ICD": TableLayout("DIAGNOSES_ICD.csv"),
        "PROCEDURES_ICD": TableLayout("PROCEDURES_ICD.csv"),
        "PATIENTS": TableLayout("PATIENTS.csv"),
    },
    csv_notes="NOTEEVENTS.csv",
    csv_codes="DIAGNOSES_ICD.csv",
)
MIMIC_IV = DatasetVersion(
    name="mimic-iv",
    note_key="NOTE_ID",
    kind_col="NOTE_TYPE",
    discharge_kind="DS",
    code_col="ICD_CODE",
    code_system="ICD-10",
    layout={
        "NOTEEVENTS": TableLayout("note/discharge.csv", multiline=True),
        "DIAGNOSES_ICD": TableLayout("hosp/diagnoses_icd.csv"),
        "PROCEDURES_ICD": TableLayout("hosp/procedures_icd.csv"),
        "PATIENTS": TableLayout("core/patients.csv"),
    },
    csv_notes="NOTE/DISCHARGE.csv",
    csv_codes="HOSP/DIAGNOSES_ICD.csv",
)

VERSIONS = {v.name: v for v in (MIMIC_III, MIMIC_IV)}

# Defaults of the job and texts that appear in results.
DEFAULT_PATIENTS = 100
MIN_PATIENTS = 10
DEFAULT_MAX_LENGTH = 512
DEFAULT_MAX_CODES = 10
DEFAULT_BATCH_SIZE = 4
INSTRUCTION = "Predict the medical codes for the following text:"
NO_DESCRIPTION = "Description not available"
EMPTY_DOCUMENT = "No text could be extracted from the PDF"


def dataset_version(name: str | DatasetVersion) -> DatasetVersion:
    """Look a version up by name, ignoring case."""
    if isinstance(name, DatasetVersion):
        return name
    try:
        return VERSIONS[name.lower()]
    except KeyError:
        raise ValueError(
            f"no dataset version is called {name}; there are {', '.join(sorted(VERSIONS))}"
        ) from None


def split_name(name: str) -> str:
    """Stored label of a split; ``validation`` is accepted for ``val``."""
    label = {"train": "train", "val": "val", "validation": "val", "test": "test"}.get(name.lower())
    if label is None:
        raise ValueError(f"no split is called {name}; there are train, val and test")
    return label


@dataclass(frozen=True)
class PrepareSettings:
    """Settings of the raw-tables-to-fact job. ``num_patients=None`` takes every patient."""

    version: str = "mimic-iii"
    num_patients: int | None = DEFAULT_PATIENTS
    train: float = 0.8
    val: float = 0.1
    test: float = 0.1
    seed: float = 0.42
    shuffled: bool = False
    overwrite: bool = False

    def __post_init__(self) -> None:
        dataset_version(self.version)
        if self.num_patients is not None and self.num_patients < MIN_PATIENTS:
            raise ValueError(f"num_patients must be at least {MIN_PATIENTS}")
        if not -1.0 <= self.seed <= 1.0:
            raise ValueError("seed must lie between -1 and 1")
