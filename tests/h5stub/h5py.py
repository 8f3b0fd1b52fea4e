"""What the HDF5 source uses of h5py, kept in a zip of arrays: groups of one level, datasets that grow, scalars."""

import numpy as np


class Dataset:
    def __init__(self, data):
        self.data = np.asarray(data)

    shape = property(lambda self: self.data.shape)

    def __len__(self):
        return len(self.data)

    def __getitem__(self, key):
        return self.data[key]

    def __setitem__(self, key, value):
        self.data[key] = value

    def resize(self, shape):
        old, self.data = self.data, np.zeros(shape, self.data.dtype)
        self.data[: len(old)] = old


class Group(dict):
    def create_dataset(self, name, data=None, shape=None, maxshape=None, dtype=None, chunks=None):
        self[name] = Dataset(np.zeros(shape, dtype) if data is None else data)
        return self[name]


class File(dict):
    def __init__(self, path, mode):
        super().__init__()
        self.path, self.mode = path, mode
        if mode == "r":
            with open(path, "rb") as f, np.load(f) as z:
                for name in z.files:
                    group, _, own = name.partition("/")
                    if own:
                        self.setdefault(group, Group())[own] = Dataset(z[name])
                    else:
                        self[group] = Dataset(z[name])

    def create_group(self, name):
        self[name] = Group()
        return self[name]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.mode == "w":
            flat = {k: v.data for k, v in self.items() if isinstance(v, Dataset)}
            flat |= {f"{k}/{c}": d.data for k, v in self.items() if isinstance(v, Group) for c, d in v.items()}
            with open(self.path, "wb") as f:
                np.savez(f, **flat)
