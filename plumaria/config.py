"""Settings of the command line and the watched folder: defaults, overridden by a YAML file."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, fields


@dataclass
class Config:
    """The names and defaults of the settings, so that existing files keep their meaning. Unknown names in a file are ignored."""

    input_dir: str = "documentos/originales"
    output_dir: str = "documentos/markdown"
    errors_dir: str = "documentos/errores"
    language: str = "es"
    min_chars_text: int = 100
    min_ocr_conf: float = 60.0
    remove_headers_footers: bool = True
    include_page_markers: bool = True
    recursive: bool = False
    overwrite: bool = False
    watch_dir: str = "documentos/entrada"
    processed_dir: str = "documentos/procesados"
    vault_dir: str | None = None
    vault_subdir: str = "PDF importados"
    vault_tag: str = "pdf-importado"
    auto_relate: bool = False
    relate_threshold: float = 0.22
    relate_top_k: int = 6
    relate_keywords: int = 8
    relate_lexicon: str | None = None
    relate_embed_weight: float = 0.40

    @classmethod
    def load(cls, path: str | None = "config.yaml") -> Config:
        """The defaults where there is no file or no YAML reader."""
        try:
            import yaml
        except ImportError:
            return cls()
        if not path or not os.path.exists(path):
            return cls()
        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
        known = {x.name for x in fields(cls)}
        return cls(**{k: v for k, v in data.items() if k in known})

    def as_dict(self) -> dict:
        return asdict(self)

    @property
    def notes_dir(self) -> str | None:
        """The folder of the vault that takes the notes."""
        return None if not self.vault_dir else os.path.join(self.vault_dir, self.vault_subdir) if self.vault_subdir else self.vault_dir

    def settings(self):
        from plumaria.plans.vault import Settings

        return Settings(threshold=float(self.relate_threshold), top_k=int(self.relate_top_k), keywords=int(self.relate_keywords), embed_share=float(self.relate_embed_weight))
