"""Dataset descriptions: everything that differs between raw flow datasets, as data."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    label: tuple[str, ...]            # candidates, first present wins
    label_mode: str = "token"         # token | set | mixed
    benign: tuple[str, ...] = ("BENIGN",)
    trim_label: bool = True
    drop: tuple[str, ...] = ()
    clean: str = "strict"             # strict | flexible
    sample: float | None = None       # stratified share per (file, chunk, label)
    categories: tuple[str, ...] = ()
    header: tuple[str, ...] | None = None   # column names of headerless files
    encoding: str = "UTF-8"
    files: tuple[str, ...] = ("*.csv",)      # patterns, first one with a file wins
    stems: tuple[str, ...] | None = None     # exact file stems to keep
    exclude: tuple[str, ...] = ()            # words in a file name that rule it out
    extra: tuple[str, ...] = ()              # further columns carried along as metadata
    side_file: tuple[str, ...] = ()          # optional column-list files
    notes: dict = field(default_factory=dict, compare=False)


# Column names of the headerless dataset, in file order.
NB15_COLUMNS = (
    "srcip", "sport", "dstip", "dsport", "proto", "state", "dur", "sbytes", "dbytes", "sttl",
    "dttl", "sloss", "dloss", "service", "Sload", "Dload", "Spkts", "Dpkts", "swin", "dwin",
    "stcpb", "dtcpb", "smeansz", "dmeansz", "trans_depth", "res_bdy_len", "Sjit", "Djit", "Stime",
    "Ltime", "Sintpkt", "Dintpkt", "tcprtt", "synack", "ackdat", "is_sm_ips_ports",
    "ct_state_ttl", "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd", "ct_srv_src", "ct_srv_dst",
    "ct_dst_ltm", "ct_src_ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm",
    "attack_cat", "Label",
)

# Labels, benign tokens and dropped columns of each dataset.
_IDS = DatasetSpec("ids2017", (" Label",), drop=(" Destination Port",))
_TLS = DatasetSpec("malicious-tls", ("Label",), benign=("benign",), drop=(
    "tls_version", "tls_chosen_cipher_suit", "tls_cipher_suites_0", "tls_cipher_suites_1",
    "tls_cipher_suites_2", "tls_cipher_suites_3", "tls_cipher_suites_4"))
_KDD = DatasetSpec("kdd", ("Class",), benign=("0",), trim_label=False)
_IOT = DatasetSpec("iot-2023", ("Label",), drop=(" Destination Port",), sample=0.01)
_DAPT = DatasetSpec(
    "dapt-2020", ("Activity", "Stage"), label_mode="set", benign=("NORMAL", "BENIGN"),
    clean="flexible", extra=("Activity", "Stage"),
    drop=("Flow ID", "Src IP", "Src Port", "Dst Port", "Timestamp", "Timestamps"))
_DDOS = DatasetSpec(
    "ddos-2019", ("Label", " Label", "label", " label"), sample=0.01,
    drop=("Unnamed: 0", "Flow ID", " Source IP", " Destination IP", " Timestamp", " Source Port",
          " Destination Port"))
_NB15 = DatasetSpec(
    "unsw-nb15", ("Label",), label_mode="mixed", header=NB15_COLUMNS, encoding="windows-1252",
    categories=("proto", "service", "state"), drop=("attack_cat", "srcip", "dstip"),
    extra=("attack_cat",), files=("UNSW-NB15_*.csv",),
    stems=("UNSW-NB15_1", "UNSW-NB15_2", "UNSW-NB15_3", "UNSW-NB15_4"),
    side_file=("UNSW_NB15_features.csv", "UNSW-NB15_features.csv", "NUSW-NB15_features.csv",
               "unsw_nb15_features.csv", "unsw-nb15_features.csv"))
_NB15_LOW = DatasetSpec(**{
    **{k: getattr(_NB15, k) for k in _NB15.__dataclass_fields__},
    "name": "unsw-nb15-lowvar", "stems": None,
    "files": ("UNSW_NB15_lowvar.csv", "UNSW-NB15-lowvar.csv", "*lowvar*.csv", "*.csv"),
    "exclude": ("feature", "list", "event", "gt")})

REGISTRY = {s.name: s for s in (_IDS, _TLS, _KDD, _IOT, _DAPT, _DDOS, _NB15, _NB15_LOW)}
_LOW_NAMES = ("unsw-nb15-lowvar", "unsw-nb15-low-variance", "unsw-nb15-lowvariance")


def dataset_spec(name: str, data_type: str = "csv") -> DatasetSpec:
    """Spec for a dataset name; case, underscores and a '-lowvar' suffix are tolerated."""
    if data_type != "csv":
        raise ValueError(f"no raw flow loader for data type {data_type!r}")
    key = name.lower().replace("_", "-")
    if key in _LOW_NAMES:
        return _NB15_LOW
    if key in REGISTRY:
        return REGISTRY[key]
    base = key.removesuffix("-lowvar")
    if base in REGISTRY:
        return REGISTRY[base]
    if "unsw-nb15" in key:
        return _NB15
    raise ValueError(f"unknown dataset {name!r}: pass a DatasetSpec")
