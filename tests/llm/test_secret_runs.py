"""Random keys in the places where they stand are masked whole."""

import re

import numpy as np

from sceneweave.llm import secrets

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def test_keys_behind_names_are_masked_whole():
    rng = np.random.default_rng(0)
    for characters, length, least in (("0123456789ABCDEF", 32, 0.97), ("0123456789ABCDEF", 64, 1), (LETTERS + "0123456789", 40, 1), (LETTERS, 32, 0.99)):
        for name in ("KEY_ID=", "", "user/key-", "id_"):
            keys = ["".join(rng.choice(list(characters), length)) for _ in range(300)]
            whole = [not re.search("[0-9A-Za-z]{4}", secrets.redact(f"set {name}{k}, then").replace("[SECRET]", "").replace("set", "").replace("then", "").replace(name, "")) for k in keys]
            assert np.mean(whole) >= least, (characters, length, name)


def test_words_stay():
    for plain in ("getElementByIdAndClassName", "internationalizationAndLocalizationSupport", "Donaudampfschifffahrtsgesellschaft", "path=docs/chapter_twelve/introduction", "AbstractSingletonProxyFactoryBean", "abcdefghij" * 2 + "2024"):
        assert secrets.redact(plain) == plain
