"""The work folder follows the caller, the setting, the context, and only on a local master falls back."""

from types import SimpleNamespace

import pytest

from castwright.sources.scratch import work_folder


def session(master="local[2]", setting=None, checkpoint=None):
    context = SimpleNamespace(master=master, applicationId="app", getCheckpointDir=lambda: checkpoint)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting), sparkContext=context)


def test_order_of_places():
    assert work_folder(session(setting="s3a://x/", checkpoint="/y"), "n", base="/z") == "/z/castwright-app/n"
    assert work_folder(session(setting="s3a://x/", checkpoint="/y"), "n") == "s3a://x/castwright-app/n"
    assert work_folder(session(checkpoint="/y"), "n") == "/y/castwright-app/n"


def test_unset():
    assert work_folder(session(), "n") == work_folder(session(), "n")
    with pytest.raises(ValueError, match="shared folder"):
        work_folder(session(master="spark://host:7077"), "n")
