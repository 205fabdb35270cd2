"""The queries of this folder by name."""

from __future__ import annotations

from collections.abc import Callable

from corpuslens.llm.brown import op3_brown
from corpuslens.llm.chat import op8_chat
from corpuslens.llm.hilbert import op6_hilbert
from corpuslens.llm.langid import op9_langid
from corpuslens.llm.media import op1_media
from corpuslens.llm.mixing import op2_entropy_mix
from corpuslens.llm.oracles import ORACLES as ORACLES
from corpuslens.llm.packing import op4_packing
from corpuslens.llm.repetition import op5_repetition
from corpuslens.llm.simhash import op10_simhash
from corpuslens.llm.wavelet import op7_wavelet

QUERIES: dict[str, Callable] = {
    "op1_media": op1_media,
    "op2_entropy_mix": op2_entropy_mix,
    "op3_brown": op3_brown,
    "op4_packing": op4_packing,
    "op5_repetition": op5_repetition,
    "op6_hilbert": op6_hilbert,
    "op7_wavelet": op7_wavelet,
    "op8_chat": op8_chat,
    "op9_langid": op9_langid,
    "op10_simhash": op10_simhash,
}
