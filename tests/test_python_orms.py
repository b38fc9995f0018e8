"""Models of Python ORMs."""

import pytest
from building import build

from tessera.parsers import parse_file, python_orms

DJANGO = '''
from django.db import models
from django.conf import settings

class Status(models.TextChoices):
    DRAFT = 'draft', 'Draft'
    PUBLISHED = 'published', 'Published'

class TimestampedModel(models.Model):
    """Reusable timestamps."""
    created_at = models.DateTimeField(auto_now_add=True)

    class Meta:
        abstract = True

class Author(models.Model):
    name = models.CharField(max_length=100)
    email = models.EmailField(unique=True, null=True)
    user = models.OneToOneField(settings.AUTH_USER_MODEL, on_delete=models.CASCADE)

    class Meta:
        db_table = 'authors'
        unique_together = (('name', 'email'),)

class Tag(models.Model):
    name = models.CharField(max_length=50, unique=True)

class Post(TimestampedModel):
    # commented_out = models.IntegerField()
    title = models.CharField(max_length=200, db_comment="Headline")
    author = models.ForeignKey(Author, on_delete=models.CASCADE, related_name='posts')
    editor = models.ForeignKey('Author', on_delete=models.SET_NULL, null=True)
    tags = models.ManyToManyField('Tag', related_name='posts')
    status = models.CharField(max_length=10, choices=Status.choices, default='draft')
'''


def find(parsed, model):
    return next(e for e in parsed.entities if e.model_name == model)


def names(e):
    return [c.name for c in e.columns]


def test_django():
    p = parse_file("blog/models.py", DJANGO)[0]
    assert p.kind == "django"
    author, post = find(p, "Author"), find(p, "Post")
    assert (author.name, author.name_certainty, author.group) == ("authors", 2, "blog") and names(author) == ["id", "name", "email", "user_id"]
    assert author.columns[0].type == "BigAutoField" and author.indexes[0].columns == ["name", "email"]
    assert find(p, "Tag").name == "blog_tag" and find(p, "Tag").name_certainty == 0
    assert post.extends == ["TimestampedModel"] and find(p, "TimestampedModel").abstract
    assert next(c for c in post.columns if c.name == "title").comment == "Headline"
    links = {r.from_columns[0]: r for r in p.relations if r.from_columns}
    assert (links["user_id"].to.name, links["user_id"].cardinality) == ("auth_user", "one-to-one")
    assert links["editor_id"].on_delete == "SET NULL" and links["editor_id"].optional
    assert p.enums[0].values == ["draft", "published"]
    r = build([p])
    post = next(e for e in r["entities"] if e["id"] == "blog_post")
    assert [c["name"] for c in post["columns"]] == ["created_at", "id", "title", "author_id", "editor_id", "status"]
    assert next(c for c in post["columns"] if c["name"] == "status")["enum_ref"] == "status"
    many = next(x for x in r["relations"] if x["cardinality"] == "many-to-many")
    assert (many["from"], many["to"], many["through_name"]) == ("blog_post", "blog_tag", "blog_post_tags")
    assert python_orms.django("apps/blog/models/post.py", "from django.db import models\nclass Post(models.Model):\n    t = models.CharField()\n").entities[0].name == "blog_post"
    assert not python_orms.django_detect("blog/migrations/0001.py", DJANGO)


SQLALCHEMY = """
from sqlalchemy import Column, ForeignKey, Integer, String, Table, Enum
from sqlalchemy.orm import Mapped, mapped_column, relationship, DeclarativeBase

class Base(DeclarativeBase):
    pass

class Stamp:
    created: Mapped[int] = mapped_column()

links = Table('user_groups', Base.metadata, Column('user_id', ForeignKey('users.id'), primary_key=True), Column('group_id', ForeignKey('auth.groups.id', ondelete='cascade'), primary_key=True))

class User(Stamp, Base):
    __tablename__ = 'users'
    __table_args__ = (UniqueConstraint('name', 'email', name='uq'), {'schema': 'app'})
    id = Column(Integer, primary_key=True)
    name: Mapped[str] = mapped_column(String(30))
    email: Mapped[Optional[str]] = mapped_column(unique=True)
    role = Column(Enum('a', 'b', name='role'), nullable=False, comment='what')
    team_id: Mapped[int] = mapped_column(ForeignKey('teams.id'))
    groups = relationship('Group', secondary=links)

class Team(Base):
    __tablename__ = 'teams'
    id: Mapped[int] = mapped_column(primary_key=True)
"""

ALEMBIC = """
revision = 'bbb'
down_revision = 'aaa'
from alembic import op
import sqlalchemy as sa

def upgrade():
    op.create_table('users', sa.Column('id', sa.Integer(), nullable=False), sa.Column('t', sa.String(length=5)), sa.ForeignKeyConstraint(['t'], ['teams.id'], name='fk_t', ondelete='CASCADE'), sa.PrimaryKeyConstraint('id'), schema='app')
    op.add_column('posts', sa.Column('user_id', sa.Integer(), sa.ForeignKey('users.id')))
    with op.batch_alter_table('posts') as batch_op:
        batch_op.drop_column('old')
        batch_op.alter_column('a', new_column_name='b', nullable=False)
    op.create_index('ix', 'posts', ['b'], unique=True)
    op.drop_constraint('fk_old', 'posts', type_='foreignkey')
    op.rename_table('x', 'y')

def downgrade():
    op.drop_table('users')
"""


def test_sqlalchemy():
    p = python_orms.sqlalchemy("m.py", SQLALCHEMY)
    user = find(p, "User")
    assert (user.name, user.schema, user.indexes[0].name, user.extends) == ("users", "app", "uq", ["Stamp"]) and find(p, "Stamp").abstract
    assert [(c.name, c.type, c.nullable) for c in user.columns] == [("id", "Integer", False), ("name", "String(30)", False), ("email", "str", True), ("role", "role", False), ("team_id", "int", False)]
    assert p.enums[0].values == ["a", "b"] and user.columns[3].comment == "what"
    through = next(r for r in p.relations if r.cardinality == "many-to-many")
    assert through.through.name == "user_groups" and through.to.model == "Group"
    group = next(r for r in p.relations if r.from_columns == ["group_id"])
    assert (group.to.name, group.to.schema, group.on_delete) == ("groups", "auth", "CASCADE")
    assert "teams" in {x["to"] for x in build([p])["relations"]}


def test_alembic():
    p = python_orms.sqlalchemy("alembic/versions/b.py", ALEMBIC)
    assert (p.origin, p.revision, p.after) == ("migration", "bbb", ["aaa"])
    users = p.entities[0]
    assert users.schema == "app" and users.columns[0].primary_key and p.relations[0].name == "fk_t"
    assert [o.op for o in p.ops] == ["dropColumn", "renameColumn", "alterColumn", "dropForeignKey", "renameTable"]
    assert p.ops[0].table.name == "posts" and p.ops[2].column == "b" and p.entities[2].indexes[0].unique


def test_sqlmodel():
    p = python_orms.sqlmodel(
        "m.py",
        "from sqlmodel import SQLModel, Field, Relationship\nclass Link(SQLModel, table=True):\n    team_id: int = Field(foreign_key='team.id', primary_key=True)\nclass HeroBase(SQLModel):\n    name: str\nclass Hero(HeroBase, table=True):\n    id: Optional[int] = Field(default=None, primary_key=True)\n    age: int | None = None\n    teams: list['Team'] = Relationship(link_model=Link)\n",
    )
    hero = find(p, "Hero")
    assert hero.extends == ["HeroBase"] and find(p, "HeroBase").abstract and [(c.name, c.type, c.nullable) for c in hero.columns] == [("id", "int", False), ("age", "int", True)]
    assert [(r.to.name or r.to.model, r.cardinality) for r in p.relations] == [("team", "many-to-one"), ("Team", "many-to-many")]


def test_peewee_and_tortoise():
    p = python_orms.peewee("m.py", "from peewee import *\nclass Base(Model):\n    class Meta:\n        database = db\nclass User(Base):\n    name = CharField(unique=True)\nclass Tweet(Base):\n    user = ForeignKeyField(User, on_delete='CASCADE', null=True)\n    class Meta:\n        table_name = 'tw'\n        indexes = ((('user', 'id'), True),)\n")
    tweet = find(p, "Tweet")
    assert find(p, "Base").abstract and tweet.name == "tw" and names(tweet) == ["id", "user_id"] and tweet.indexes[0].unique
    assert p.relations[0].on_delete == "CASCADE" and p.relations[0].optional
    p = python_orms.tortoise("m.py", "from tortoise import fields\nfrom tortoise.models import Model\nclass Team(Model):\n    id = fields.IntField(pk=True)\nclass Event(Model):\n    team = fields.ForeignKeyField('models.Team', on_delete=fields.CASCADE)\n    people = fields.ManyToManyField('models.Person', through='event_person')\n    class Meta:\n        table = 'events'\n")
    event = find(p, "Event")
    assert event.name == "events" and names(event) == ["id", "team_id"] and find(p, "Team").columns[0].generated
    assert p.relations[0].to.model == "Team" and p.relations[0].on_delete == "CASCADE" and p.relations[1].through.name == "event_person"


@pytest.mark.parametrize("text", [DJANGO, SQLALCHEMY, ALEMBIC, "class", "class A(\n", "\0", "def f(:\n  x = 'a"])
def test_half_typed_files(text):
    for n in range(0, len(text) + 1, 37):
        parse_file("blog/models.py", text[:n])
    shape = lambda t: [(e.name, names(e), e.source.line) for p in parse_file("blog/models.py", t) for e in p.entities]
    assert shape(text) == shape(text.replace("\n", "\r\n"))


def test_what_is_broken_costs_only_itself():
    p = python_orms.django("blog/models.py", DJANGO + "\nclass Broken(models.Model):\n    ok = models.CharField(max_length=1)\n    bad = models.CharField(\n")
    assert names(find(p, "Broken")) == ["id", "ok"] and names(find(p, "Author"))[1] == "name"


def test_each_broken_class_gives_what_stands_before_its_error():
    fields = "\n".join(f"    f{i} = models.IntegerField()" for i in range(30))
    text = "from django.db import models\n" + "".join(f"class Ship{i}(models.Model):\n{fields}\n    broken = models.CharField(max_length=\n    after = models.TextField()\n\n" for i in range(60)) + "class Last(models.Model):\n    name = models.TextField()\n"
    (p,) = [x for x in parse_file("fleet/models.py", text) if x.kind == "django"]
    assert [e.model_name for e in p.entities] == [*(f"Ship{i}" for i in range(60)), "Last"]
    assert all(len(e.columns) == 31 for e in p.entities[:-1])
