"""Numpy arrays as files in the shared folder (``playlens.functions.shared_files``)."""

from playlens.functions.shared_files import load, new_folder, save

__all__ = ["load", "new_folder", "save"]
